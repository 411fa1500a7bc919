import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm.leaks import Index, Words, leaks

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall("[a-z0-9]+", text.lower()) if text else []


def model(docs, items, run):
    held = {}
    for i, t in items:
        w = words(t) if i is not None else []
        for j in range(len(w) - run + 1):
            held.setdefault(tuple(w[j : j + run]), set()).add(i)
    return sorted({(d, i) for d, t in docs if d is not None for w in [words(t)] for j in range(len(w) - run + 1) for i in held.get(tuple(w[j : j + run]), ())}, key=repr)


def frames(spark, docs, items):
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for c in ("doc", "item", "item_id"):
        d = d.withColumn(c, F.lit("x"))
    return d, i.withColumn("doc", F.lit("x"))


@pytest.mark.parametrize("run", [13, 5, 2])
def test_random_texts(spark, rows, run):
    rng = random.Random(run)
    pool = [f"w{i}" for i in range(6)] + ["The", "OF", "and"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(pool, k=n))
    items = [(i, say(rng.randrange(40))) for i in range(30)] + [(None, "The OF and " * 20), (90, None), (91, ""), (92, "ab cd")]
    docs = []
    for i in range(150):
        t = say(rng.randrange(60))
        if i % 3 == 0:
            t += " " + (rng.choice(items[:30])[1])
        docs.append((i, t))
    docs += [(None, docs[0][1]), (900, None), (901, ""), (902, "日本語 ! ?"), (5, docs[3][1])]
    d, q = frames(spark, docs, items)
    want = model(docs, items, run)
    assert rows(leaks(d, q, run=run)) == want
    # the items in several parts and in pieces, searched for few documents at a time
    assert rows(leaks(d, q, run=run, index_bytes=300, piece=4, held_bytes=1000)) == want


def test_long_text_and_lanes(spark, rows):
    rng = random.Random(1)
    w = [f"x{rng.randrange(50_000)}" for _ in range(30_000)]
    items = [(i, " ".join(w[at : at + 13])) for i, at in enumerate((0, 500, 505, 511, 512, 513, 1024, 29_987))] + [(99, " ".join(w[7:19]))]
    d, q = frames(spark, [(1, " ".join(w).upper()), (2, " ".join(w[1:13]))], items)
    assert rows(leaks(d, q)) == [(1, i) for i in range(8)]


def test_empty(spark):
    d, q = frames(spark, [(1, "a b c")], [(1, "a b c")])
    assert leaks(d.limit(0), q).collect() == leaks(d, q.limit(0)).collect() == leaks(d, q).collect() == []


def test_words():
    texts = ["Ab-c  d1\nE", None, "", "日本x語y", "\n\n", "K9 İ", "end"]
    w = Words(texts)
    at = [w.norm[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert [at[a:b] for a, b in zip(w.offsets, w.offsets[1:])] == [words(t) for t in texts]
    assert len(set(w.token)) == len(set(at)) and Words([]).offsets.tolist() == [0]


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With a hash that takes all words for one only the comparison of the letters is left."""
    monkeypatch.setattr(Words, "_hashes", lambda self, a, b: np.zeros(b - a, np.uint64))
    items = ["a b c d", "a b c", "x y z", "aa b c"]
    index = Index.build(list(range(4)), items, 3)
    text, item = index.search(Words(["q a b c", "b c d", "a b", "x y zz", "aa b c", "x y z"]))
    assert list(zip(text, item)) == [(0, 0), (0, 1), (1, 0), (4, 3), (5, 2)]


def test_size_of_an_index():
    rng = random.Random(0)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(2000)) for _ in range(100)]
    index = Index.build(list(range(100)), texts, 13)
    size = sum(getattr(index, name).nbytes for name, _ in Index.ARRAYS)
    assert size < 8 * sum(map(len, texts))


def test_an_item_that_many_share(spark, rows):
    """A third of the items are one passage: each of them leaks where it stands."""
    say = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    d, q = frames(spark, [(1, f"so {say} end"), (2, say[4:]), (3, say[8:])], [(i, say if i % 3 == 0 else f"w{i} " * 20) for i in range(900)] + [(0, say)] * 50)
    assert rows(leaks(d, q, index_bytes=2000)) == sorted(((doc, i) for doc in (1, 2) for i in range(0, 900, 3)), key=repr)
