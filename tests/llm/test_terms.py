import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm.terms import TermCounts, deliveries
from strandloom.session import names_in, scratch_path

SCHEMA = "id string, read_f string, read_r string"


def model(rows, k):
    """Counts of the terms of the records, and their number."""
    total, held = Counter(), Counter()
    one = {}
    for i, f, r in rows:
        if i is not None:
            one.setdefault(i, set()).update(x for x in (("f", f), ("r", r)) if x[1])
    for reads in one.values():
        terms = [s[j : j + k] for _, s in reads for j in range(len(s) - k + 1) if set(s[j : j + k]) <= set("ACGT")]
        total.update(terms)
        held.update(set(terms))
    n = len(one)
    return sorted((t, total[t], c, "common" if 100 * c >= n else "rare" if c < 4 else "useful") for t, c in held.items())


def got(store):
    return sorted(tuple(r) for r in store.spelled(store.counts()).select("term", "n_total", "n_records", "mark").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("content", F.lit(1)).withColumn("term", F.lit("x"))


A = [("r1", "ACGTACG", "TTTT"), ("r2", "ACGNACGT", None), ("r3", "", "AC"), (None, "ACGT", "ACGT"), ("r1", "ACGTACG", "TTTT"), ("r5", "acgt", "GGGGG")]
B = [("r1", "ACGTACG", "TTTT"), ("r2", "CCCC", None), ("r4", "ACGT", "ACGT"), ("r5", None, None)]


@pytest.mark.parametrize("compact", [0.5, 100])
def test_added_changed_and_deleted_records(spark, compact):
    store = TermCounts(spark, k=3, buckets=5, compact=compact)
    for state in (A, B, B, A, []):
        store.apply_snapshot(frame(spark, state))
        assert got(store) == model(state, 3)
        assert sorted(store.records().collect()) == sorted({r for r in state if r[0] is not None}, key=lambda r: (r[0], r[1] is not None, r))


def test_rows_of_one_id_are_one_record(spark):
    s, t, u = "ACGTTGCAACGTAGGC", "TTGACCATGACCATTA", "GGATTTTTTCACGTTG"
    rows = [("a", None, t), ("a", s, t), ("b", s, None), ("c", s, t), ("c", u, s), ("c", u, s), ("d", None, None), ("d", s, s)]
    store = TermCounts(spark, k=5, buckets=3, compact=100).apply(frame(spark, rows))
    assert got(store) == model(rows, 5)
    # a loses a row, c gets one, d goes; ids that aren't there and rows without an id change nothing
    after = [("a", None, t), ("b", s, None), ("c", s, t), ("c", u, s), ("c", None, u)]
    store.apply(frame(spark, [r for r in after if r[0] in "ac"] + [(None, s, s)]), spark.createDataFrame([("d",), ("zz",), ("a",), (None,)], "id string"))
    assert got(store) == model(after, 5)


def test_an_id_of_many_rows(spark):
    rng = random.Random(3)
    rows = [("hot", "".join(rng.choices("ACGT", k=20)), None) for _ in range(800)] + [(f"r{i}", "".join(rng.choices("ACGT", k=20)), "ACGTACGT") for i in range(400)]
    assert got(TermCounts(spark, k=4).apply(frame(spark, rows))) == model(rows, 4)


def test_a_store_is_opened_again_by_its_path(spark):
    path = scratch_path(spark, "store")
    TermCounts(spark, k=3, buckets=5, path=path).apply(frame(spark, A)).close()
    again = TermCounts(spark, k=3, path=path)
    assert again.buckets == 5 and got(again) == model(A, 3)
    again.apply_snapshot(frame(spark, B))
    assert got(TermCounts(spark, k=3, path=path)) == model(B, 3)
    live = TermCounts(spark, k=3, path=path).state
    assert sorted([live["table"], *live["log"], f"manifest-{live['version']:09}.json"]) == names_in(spark, path)  # nothing old stays
    with pytest.raises(ValueError):
        TermCounts(spark, k=4, path=path)


def test_a_small_change_writes_little(spark):
    rng = random.Random(5)
    make = lambda i: (f"r{i}", "".join(rng.choices("ACGT", k=100)), None)
    store = TermCounts(spark, k=21, buckets=4).apply(frame(spark, [make(i) for i in range(2000)]))
    base = dict(store.state["counts"])
    store.apply(frame(spark, [make(7000)]))
    assert list(store.state["counts"].values()) == [*base.values(), 80] and list(store.state["log"].values()) == [2000, 1]
    plan = store.counts()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # base and deltas are summed where they lie


def test_deltas_are_compacted(spark):
    store = TermCounts(spark, k=2, buckets=2, compact=0.5)
    rows = []
    for i in range(6):
        rows.append((f"r{i}", "ACGT"[i % 4] * 5 + "GATTACA", "CC"))
        store.apply(frame(spark, rows[-1:]))
        assert got(store) == model(rows, 2)
        assert len(store.state["counts"]) <= 2


def test_marks(spark):
    rows = [(f"r{i}", "AAAA" + "CGT" * (i < 4), "GATC" if i < 3 else "TTTTT") for i in range(500)]
    store = TermCounts(spark, k=4).apply(frame(spark, rows))
    assert got(store) == model(rows, 4)
    assert {r[3] for r in got(store)} == {"common", "rare", "useful"}


def test_nothing_and_long_records(spark):
    assert got(TermCounts(spark, k=3)) == []
    assert got(TermCounts(spark, k=3).apply(frame(spark, []))) == []
    long = "ACGTTGCA" * 40_000
    for k in (24, 31):
        store = TermCounts(spark, k=k).apply(frame(spark, [("a", long, long), ("b", long[3:70], None)]))
        assert got(store) == model([("a", long, long), ("b", long[3:70], None)], k)


def test_deliveries(spark):
    df = spark.createDataFrame([(i % 50, i % 7 or None) for i in range(70)], "n int, at int").withColumn("cut", F.lit(0))
    early, late = deliveries(df, "at", "n", 0.5)
    after = {r["n"] for r in df.collect() if r["at"] is None or r["at"] > early.agg(F.max("at")).first()[0]}
    assert 0 < early.count() < 60 and late.count() == sum(r["n"] in after for r in df.collect())


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.sampled_from("abcd"), st.tuples(st.text("ACGN", max_size=9), st.one_of(st.none(), st.text("AC", max_size=6))), max_size=4), min_size=2, max_size=3))
def test_any_history(spark, states):
    store = TermCounts(spark, k=2, buckets=3)
    for s in states:
        rows = [(i, *v) for i, v in s.items()]
        store.apply_snapshot(frame(spark, rows))
        assert got(store) == model(rows, 2)
