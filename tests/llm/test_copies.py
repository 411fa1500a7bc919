import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandloom.llm.dictionary import collapse, copies
from strandloom.llm.similar import _met, bare_classes, classes, linked_classes, near_duplicates, similar_classes
from strandloom.operators import skew

SCHEMA = "read_no long, seq_f string, seq_r string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("copies", "keep", "value", "value_id", "rep", "content", "_salt", "a", "b", "sig"):
        df = df.withColumn(c, F.lit("x"))
    return df


def groups(rows):
    out = defaultdict(list)
    for n, f, r in rows:
        if n is None or f is None or r is None:
            continue
        f, r = (re.sub("[^A-Z]", "", s.upper()) for s in (f, r))
        if set(f) & set("ACGT") and set(r) & set("ACGT"):
            out[min((f, r), (r, f))].append(n)
    return out


def pairs(rows):
    sets = {k: {s[i : i + 10] for s in k for i in range(len(s) - 9)} for k in groups(rows)}
    out = set()
    for x, a in groups(rows).items():
        for y, b in groups(rows).items():
            s, u = len(sets[x] & sets[y]), len(sets[x] | sets[y])
            if x < y and 10 * s >= 6 * u:
                out |= {(min(i, j), max(i, j)) for i in a for j in b}
    return out


def some(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def messy(rng, s):
    s = "".join(rng.choice([c, c.lower()]) for c in s)
    at = rng.randrange(len(s))
    return s[:at] + rng.choice([" ", "\r\n", "-12", "​", "."]) + s[at:]


def sample(rng, n):
    rows = []
    for _ in range(n):
        f, r = some(rng, rng.randrange(30, 90)), some(rng, rng.randrange(30, 90))
        rows.append((f, r))
        for _ in range(rng.choice([0, 0, 1, 3])):
            g = list(f)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(g))
                g[i : i + 1] = rng.choice([[], [rng.choice("ACGTN")], [g[i], rng.choice("ACGT")]])
            g = messy(rng, "".join(g))
            rows.append((g, messy(rng, r)) if rng.random() < 0.5 else (messy(rng, r), g))
    rows += [(None, "ACGT"), ("ACGT", None), ("", "ACGT"), ("12-", "ACGT"), ("NNN", "ACGT"), ("acgt", "A"), ("A", "AC-GT"), ("CC", "GG"), rows[0], rows[0]]
    return [(i * 7 % 10_007, *x) for i, x in enumerate(rows)] + [(None, *rows[0]), (None, *rows[1])]


def test_copies_of_any_writing(spark, rows):
    src = sample(random.Random(1), 60)
    assert rows(copies(frame(spark, src))) == sorted((min(v), len(v)) for v in groups(src).values() if len(v) > 1)


def test_hot_value_with_many_partners(spark, rows):
    rng = random.Random(2)
    hot = some(rng, 40)
    src = [(i, hot if i % 2 else hot.lower() + " ", some(rng, 5)) for i in range(900)] + [(1000 + i, "ACGT", "CC") for i in range(500)]
    want = Counter({min(v): len(v) for v in groups(src).values()})
    assert dict(rows(collapse(frame(spark, src), "read_no", ["seq_f", "seq_r"]))) == want


def test_similar_pairs_are_all_found(spark, rows):
    src = sample(random.Random(3), 80)
    got = rows(near_duplicates(frame(spark, src)))
    assert len(got) == len(set(got)) and set(got) == pairs(src)


def test_classes_and_links(spark, rows):
    src = sample(random.Random(4), 40)
    got = {n: (c, k) for n, c, k in rows(linked_classes(frame(spark, src)))}
    rep = {n: min(v) for v in groups(src).values() for n in v}
    links = Counter(x for a, b in {tuple(sorted((rep[a], rep[b]))) for a, b in pairs(src)} for x in (a, b))
    assert got == {n: (c, links[c]) for n, c in rep.items()}


def test_near_threshold_none_is_missed(spark, rows):
    # pairs made to lie just above and below the threshold: the signature may not lose one
    rng = random.Random(5)
    src = []
    for i in range(300):
        f, r = some(rng, 100), some(rng, 100)
        g = list(f)
        for _ in range(2):
            g[rng.randrange(10, 90)] = "N"
        src += [(2 * i, f, r), (2 * i + 1, "".join(g), r[: 100 - rng.randrange(35)])]
    assert set(rows(near_duplicates(frame(spark, src)))) == pairs(src)


def test_empty_and_long(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert copies(empty).collect() == near_duplicates(empty).collect() == linked_classes(empty).collect() == []
    long = some(random.Random(6), 200_000)
    src = [(1, long, "ACGTACGTAC"), (2, long[:-9] + "T", "ACGTACGTAC"), (3, "ACGTACGTAC", " " + long.lower())]
    assert rows(near_duplicates(frame(spark, src))) == [(1, 2), (2, 3)] and rows(copies(frame(spark, src))) == [(1, 2)]


def test_texts_without_a_shingle_do_not_meet(spark, rows):
    """400 texts of less than a shingle are alike to each other, which takes no variant of a signature."""
    src = [(i, "".join("ACGT"[i >> 2 * j & 3] for j in range(5)), "ACGT") for i in range(400)] + [(900, "ACGTACGTAC", "A")]
    texts, _ = classes(frame(spark, src))
    assert similar_classes(texts).count() == 0 and bare_classes(texts).count() == 400
    got = rows(near_duplicates(frame(spark, src)))
    assert got == sorted(pairs(src), key=repr) and len(got) == 400 * 399 // 2
    assert {r[2] for r in rows(linked_classes(frame(spark, src)))} == {399, 0}


def test_variants_of_many_texts(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        src = [(5, i) for i in range(60)] + [(6, i) for i in range(3)] + [(7, 8), (8, 1), (8, 2)] + [(9, i) for i in range(20, 45)]
        want = sorted({(a, b) for s, a in src for t, b in src if s == t and a < b}, key=repr)
        df = spark.createDataFrame(src, "sig long, rep long")
        for most, block in ((4, 10), (30, 7), (100, 100), (2, 1000)):
            assert rows(_met(df, most, block)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_content_in_thousands_of_writings(spark, rows, monkeypatch):
    """The content is a hot key of the dictionary; its writings are all different."""
    monkeypatch.setattr(skew, "LEAST_ROWS", 1)
    rng = random.Random(4)
    write = lambda s, i: "".join(c.lower() if i >> j & 1 else c for j, c in enumerate(s)) + f" {i}"
    f, r = some(rng, 14), some(rng, 20)
    src = [(i, write(f, i), r) if i % 2 else (i, write(r, i), write(f, i)) for i in range(3000)] + [(5000 + i, some(rng, 12), some(rng, 12)) for i in range(300)]
    assert rows(copies(frame(spark, src))) == [(0, 3000)]
