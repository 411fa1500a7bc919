import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import spans
from strandloom.llm.spans import _stretches, settled, shared_bases

SCHEMA = "id string, node_row long, read_f string, read_r string"


def model(rows, span):
    recs = {}
    for i, n, f, r in rows:
        if i is not None:
            recs.setdefault(i, set()).update(x for x in ((0, f), (1, r)) if x[1])
    held = {}
    for i, reads in recs.items():
        for _, s in reads:
            for j in range(len(s or "") - span + 1):
                if set(s[j : j + span]) <= set("ACGT"):
                    held.setdefault(s[j : j + span], set()).add(i)
    out = []
    for i, reads in recs.items():
        n = 0
        for _, s in reads:
            at = set()
            for j in range(len(s or "") - span + 1):
                if len(held.get(s[j : j + span], ())) > 1:
                    at |= set(range(j, j + span))
            n += len(at)
        if n:
            out.append((i, n))
    return sorted(out)


def texts(rng, n):
    """Reads that share pieces, among them runs, tandem repeats and strange letters."""
    pieces = ["".join(rng.choices("ACGT", k=rng.randrange(20, 70))) for _ in range(12)]
    pieces += ["A" * 55, "AC" * 30, "ACG" * 21, "T" * 20 + "G" * 25, "AACCGGTT" * 8, "A" * 39 + "C", "N" * 5, "acgt" * 12]
    return ["".join(rng.choice(pieces)[rng.randrange(6) :] for _ in range(rng.randrange(4))) for _ in range(n)]


@pytest.mark.parametrize("span", [40, 16])
def test_equal_windows_have_equal_names(span):
    rng = random.Random(7)
    names = {}
    for t in texts(rng, 400):
        data = np.frombuffer(t.encode(), np.uint8)
        start, end = _stretches(data, np.array([0, len(data)]), span)
        if len(start):
            for at, name in zip(*settled(data, start, end, span)):
                assert names.setdefault(t[at : at + span], name) == name


@pytest.mark.parametrize("span", [40, 16])
def test_shared_bases(spark, rows, span):
    rng = random.Random(span)
    t = texts(rng, 160)
    src = [(f"r{i}", i, t[2 * i], t[2 * i + 1]) for i in range(70)]
    src += [("r3", None, t[6], t[7]), (None, 901, t[0], t[1]), ("null", 902, None, t[4]), ("short", 903, "ACG", ""), ("twice", 904, "ACGT" * 3 + t[140], t[140])]
    df = spark.createDataFrame(src, SCHEMA)
    for c in ("rec", "name", "text", "first", "window", "mate"):
        df = df.withColumn(c, F.lit("x"))
    assert rows(shared_bases(df, span=span)) == model(src, span)


def test_rows_of_one_id_are_one_record(spark, rows):
    rng = random.Random(2)
    s, t, u, v = ("".join(rng.choices("ACGT", k=60)) for _ in range(4))
    assert rows(shared_bases(spark.createDataFrame([("a", 1, None, t), ("a", 2, s, t), ("b", 3, s, None)], SCHEMA))) == [("a", 60), ("b", 60)]
    src = [("a", 1, s, t), ("a", 2, u, t), ("a", 3, u, t), ("a", 4, None, None), ("b", 5, u[5:55], s), ("c", 6, t[:45], u), ("d", 7, v, v), ("d", 8, v, s[:40])]
    assert rows(shared_bases(spark.createDataFrame(src, SCHEMA))) == model(src, 40)


def test_a_hot_name_and_an_id_of_many_rows(spark, rows):
    rng = random.Random(12)
    hot = "".join(rng.choices("ACGT", k=70))
    src = [(f"r{i}", i, hot[rng.randrange(20) :], "".join(rng.choices("ACGT", k=50))) for i in range(150)]
    src += [("many", 1000 + i, hot[: 40 + i % 30], src[i][3][: 45 - i % 6]) for i in range(90)]
    df = spark.createDataFrame(src, SCHEMA)
    want = model(src, 40)
    assert rows(shared_bases(df, share=5)) == want and rows(shared_bases(df)) == want


def test_fragments_go_on_from_batch_to_batch(spark, rows, monkeypatch):
    monkeypatch.setattr(spans, "COMPARED", 3)
    t = texts(random.Random(8), 120)
    src = [(f"r{i}", i, t[2 * i], t[2 * i + 1]) for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert rows(shared_bases(spark.createDataFrame(src, SCHEMA))) == model(src, 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_span_empty_and_long(spark, rows):
    rng = random.Random(9)
    hot = "".join(rng.choices("ACGT", k=50))
    src = [(f"r{i}", i, hot if i % 2 else "".join(rng.choices("ACGT", k=60)), None) for i in range(600)]
    assert rows(shared_bases(spark.createDataFrame(src, SCHEMA))) == model(src, 40)
    assert shared_bases(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "".join(rng.choices("ACGT", k=100_000))
    src = [("a", 1, long, None), ("b", 2, None, long[500:-500]), ("c", 3, "A" * 50_000, "A" * 40)]
    assert rows(shared_bases(spark.createDataFrame(src, SCHEMA))) == [("a", 99_000), ("b", 99_000)]
