import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators.overlap import cap_frequency, degree, kmer_counts, kmers, match_prefix, remove_mirrors, to_digraph
from strandloom.operators.reads import delivery_metrics, first_value, judged, judged_deliveries, prepare_deliveries, prepare_reads, usable_nodes

SCHEMA = "id string, seq_f string, seq_r string, cov float"
K = 9


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def pairs():
    """Pairs from a genome with a repeat, mates of unequal length."""
    rng = random.Random(5)
    g = "".join(rng.choices("ACGT", k=160))
    g = g + g[20:60] + "".join(rng.choices("ACGT", k=60))
    out = []
    for i in range(40):
        at = rng.randrange(len(g) - 70)
        n, m = rng.choice([(24, 24), (20, 28), (30, 15), (10, 11)])
        out.append((f"r{i}", g[at : at + n], rc(g[at + 70 - m : at + 70]), 2.0))
    return out


def occurrences(f, r):
    out = [(f[:K], "ff", len(f), 1), (rc(f[:K]), "fr", len(f), 1), (rc(f[-K:]), "fe", len(f), 1), (f[-K:], "ef", len(f), 1)]
    out += [(r[:K], "re", len(r), 1), (rc(r[:K]), "er", len(r), 1), (rc(r[-K:]), "rr", len(r), 1), (r[-K:], "rf", len(r), 1)]
    for i in range(1, len(f) - K):
        out += [(f[i : i + K], "ff", len(f) - i, 0), (rc(f[i : i + K]), "fr", len(f) - i, 0)]
    for i in range(1, len(r) - K):
        out += [(rc(r[i : i + K]), "rr", K + i, 0), (r[i : i + K], "rf", K + i, 0)]
    return out


def full_edges(pairs):
    by = {}
    for name, f, r, _ in pairs:
        for w, t, n, a in occurrences(f, r):
            by.setdefault(w, []).append((name, t, n, a))
    return {(x[0], x[1], y[0], y[2]) for group in by.values() for x in group if x[3] for y in group if x[0] != y[0]}


def without_mirrors(edges):
    lists = {}
    for s, t, d, n in edges:
        lists.setdefault((s, t), set()).add((d, n))
    return {e for e in edges if not (e[1] in ("fr", "rf", "ef", "er") and lists[e[0], e[1]] == lists.get((e[0], {"fr": "ff", "rf": "rr", "ef": "fe", "er": "re"}[e[1]])))}


def test_kmers(spark, pairs):
    got = {(r["id"], r["kmer"], r["edge_type"], r["overlap"], int(r["is_anchor"])) for r in kmers(spark.createDataFrame(pairs, SCHEMA), K).collect()}
    assert got == {(n, w, t, o, a) for n, f, r, _ in pairs for w, t, o, a in occurrences(f, r)}


def test_full_mode_and_removed_mirrors(spark, pairs):
    df = spark.createDataFrame(pairs, SCHEMA)
    full = match_prefix(df, K, "full").collect()
    assert {tuple(r) for r in full} == full_edges(pairs) and len(full) == len(full_edges(pairs))
    want = without_mirrors(full_edges(pairs))
    assert {tuple(r) for r in remove_mirrors(match_prefix(df, K, "full")).collect()} == want
    assert {tuple(r) for r in match_prefix(df, K).collect()} == want


def test_digraph_turns_and_keeps_repeats(spark, rows):
    e = spark.createDataFrame([("a", t, "b", 1) for t in ("ff", "fe", "fr", "ef", "rr", "re", "rf", "er")] + [("a", "ff", "b", 2)], "src string, edge_type string, dst string, overlap int")
    assert rows(to_digraph(e)) == [("a", "b")] * 5 + [("b", "a")] * 4
    assert rows(degree(e)) == [("a", "f", 3), ("a", "r", 2)]


def test_cap(spark, rows):
    o = spark.createDataFrame([("k", f"i{n}", "ff", n, True) for n in range(5)], "kmer string, id string, edge_type string, overlap int, is_anchor boolean")
    assert [r[3] for r in rows(cap_frequency(o, 2))] == [3, 4]


def test_cleaning(spark, rows):
    def block(f, r, lines=8):
        return "\n".join(["@a:1/1", f, "+", "#", "@a:1/2", r, "+", "#"][:lines])

    good = "acgt" * 6
    src = [block(good, good), block(good, good, 7), block(good, "A" * 21), block(good, "A" * 21 + "N"), block(good, "ACNG" * 9), None, "", block(good, good).replace("\n", "\r\n") + "\r\n\r\n"]
    df = spark.createDataFrame(list(enumerate(src)), "n int, fields_txt string")
    assert [r["verdict"] for r in sorted(judged(df, keep=("n",), odd="drop").collect(), key=lambda r: r["n"])] == [
        "reads_good", "input_lines_invalid", "very_reads_short", "very_reads_short", "reads_non_dna", "input_lines_invalid", "input_lines_invalid", "reads_good"
    ]
    assert rows(prepare_reads(df, odd="drop")) == [("a_1", good.upper(), good.upper(), 2.0)] * 2 and prepare_reads(df).count() == 3


def test_usable_nodes(spark, rows):
    s = "ACGT" * 6
    df = spark.createDataFrame([("a", s, s, None), ("a", s, s, 1.0), (None, s, s, 1.0), ("b", s, None, 1.0), ("c", s, s[:21], 1.0), ("d", s, s + "N", 1.0)], "id string, read_f string, read_r string, cov float")
    assert rows(usable_nodes(df)) == [("a", s, s, 1.0), ("d", s, s + "N", 1.0)] and rows(usable_nodes(df, odd="drop")) == [("a", s, s, 1.0)]
    held = df.selectExpr("*", "if(id = 'a', array('x'), null) as contained")
    assert rows(usable_nodes(held, odd="drop")) == [] and usable_nodes(held).count() == 1


def test_empty(spark):
    assert match_prefix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd_letters_cost_only_their_kmers(spark, pairs, rows):
    """Against the model over all windows, less those with another letter."""
    at = lambda s, i: s[:i] + "N" + s[i + 1 :]
    odd = [(n, at(f, len(f) // 2) if i % 3 == 0 else f, at(r, 2) if i % 4 == 0 else r, c) for i, (n, f, r, c) in enumerate(pairs)]
    df = spark.createDataFrame(odd, SCHEMA)
    kept = usable_nodes(df.withColumnsRenamed({"seq_f": "read_f", "seq_r": "read_r"}), K, odd="keep")
    assert rows(kept) == sorted(odd)
    clean = [(n, w, t, o, a) for n, f, r, _ in odd for w, t, o, a in occurrences(f, r) if "N" not in w]
    assert {tuple(r) for r in kmers(kept, K).select("id", "kmer", "edge_type", "overlap", F.col("is_anchor").cast("int")).collect()} == set(clean)
    by = {}
    for n, w, t, o, a in clean:
        by.setdefault(w, []).append((n, t, o, a))
    want = {(x[0], x[1], y[0], y[2]) for g in by.values() for x in g if x[3] for y in g if x[0] != y[0]}
    assert {tuple(r) for r in match_prefix(kept, K, "full").collect()} == want
    half = [w for _, f, r, _ in odd for s in (f, r) for i in range(len(s) - K + 1) for w in [s[i : i + K]]]
    assert rows(kmer_counts(kept, K)) == [("kmers_kept", sum("N" not in w for w in half)), ("kmers_omitted", sum("N" in w for w in half))]
    block = "\n".join(["@a/1", "ACNG" * 9, "+", "#", "@a/2", "ACGT" * 9, "+", "#"])
    assert rows(prepare_reads(spark.createDataFrame([(block,)], "fields_txt string"), odd="keep")) == [("a", "ACNG" * 9, "ACGT" * 9, 2.0)]


def test_cleaning_of_both_forms(spark, rows):
    good, n = "acgt" * 6, "ACNG" * 9
    lines = "\n".join(["@a:1/1", good, "+", "#", "@a:1/2", n, "+", "#"])
    src = [
        ("lines", lines), ("csv", f"@b:1/1,{good},#,{n},#\r\n"), ("csv", f'"@c,""1/1","{good}","#,",{good},#'), ("csv", f"d,{good},#,ACGT,#"),
        ("csv", f"e,{good},#,{good}"), ("csv", f'"f,{good},#,{good},#'), ("lines", f"g,{good},#,{good},#"), ("csv", None), ("tsv", f"i,{good},#,{good},#"),
    ]
    df = spark.createDataFrame([(i, f, t, "other tag") for i, (f, t) in enumerate(src)], "block_no long, form string, fields_txt string, tag string")
    up = good.upper()
    assert rows(prepare_deliveries(df)) == [("a_1", up, n, 2.0), ("b_1", up, n, 2.0), ('c,"1', up, up, 2.0)]
    assert rows(prepare_deliveries(df.where("block_no = 0"))) == rows(prepare_reads(df.where("block_no = 0"), odd="keep"))
    verdicts = ["reads_good"] * 3 + ["very_reads_short", "arity", "quoting", "arity", "empty", "form"]
    assert [r["verdict"] for r in sorted(judged_deliveries(df).collect(), key=lambda r: r["block_no"])] == verdicts
    assert dict(rows(delivery_metrics(df)))["r_reads_with_non_dna_characters"] == 2
    assert [r[0] for r in df.where("form != 'tsv'").orderBy("block_no").select(first_value()).collect()] == ["@a:1/1", "@b:1/1", '@c,"1/1', "d", "e", None, f"g,{good},#,{good},#", ""]
