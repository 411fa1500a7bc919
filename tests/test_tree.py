from collections import defaultdict

from pyspark.sql import functions as F

from strandloom.operators.skew import hot_keys, hot_rows, salted_lookup
from strandloom.operators.tree import fan_in_pairs, prefix_stats, tree_aggregate


def model(rows):
    out = defaultdict(lambda: [0, set(), None])
    for key, member, measure in rows:
        if key is not None:
            s = out[key]
            s[0] += 1
            if member is not None:
                s[1].add(member)
            if measure is not None:
                s[2] = measure if s[2] is None else max(s[2], measure)
    return sorted((k, n, len(m), x) for k, (n, m, x) in out.items())


def test_hot_key_over_many_rounds(spark, rows):
    # one key holds two thirds of the rows; chunks of 7 rows and a fan-in of 3 make many rounds
    src = [("hot" if i % 3 else f"k{i % 11}", f"m{i % 97}" if i % 5 else None, i % 13) for i in range(2000)]
    src += [(None, "m", 1), ("only_null", None, None), ("twice", "m", 5), ("twice", "m", 5)]
    df = spark.createDataFrame(src, "key string, member string, measure int").withColumn("slot", F.lit(1)).withColumn("n_rows", F.lit("x"))
    assert rows(tree_aggregate(df, "key", "member", "measure", chunk_rows=7, fan_in=3)) == model(src)
    assert rows(tree_aggregate(df, "key", "member", "measure")) == model(src)


def test_empty_table(spark):
    df = spark.createDataFrame([], "kmer string, kmer_r string, id string, overlap int")
    assert prefix_stats(df).collect() == []


def test_prefixes_are_canonical(spark, rows):
    df = spark.createDataFrame([("acg", "CGT", "a", 3), ("CGT", "ACG", "b", 9), ("ACG", None, "c", 1), (None, "ACG", "c", 1)], "kmer string, kmer_r string, id string, overlap int")
    assert rows(prefix_stats(df)) == [("ACG", 2, 2, 9)]


def test_salted_lookup_keeps_all_rows(spark, rows):
    facts = spark.range(5000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    facts = facts.unionByName(spark.createDataFrame([(-1, None), (-2, "absent")], "n long, k string"))
    lookup = spark.createDataFrame([("hot", 0)] + [(f"k{i}", i) for i in range(50)], "k string, v int")
    plain = facts.join(lookup, "k").select("n", "v")
    assert rows(salted_lookup(facts, lookup, "k", salts=8, share=10).select("n", "v")) == rows(plain)
    left = facts.join(lookup, "k", "left").select("n", "v")
    assert rows(salted_lookup(facts, lookup, "k", salts=8, share=10, how="left").select("n", "v")) == rows(left)


def test_chunks_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    from strandloom.functions.vectors import chunks

    texts = ["x" * (i % 50) for i in range(1000)] + ["y" * 5000] + ["z"] * 10
    batches = pa.table({"t": texts}).to_batches(max_chunksize=333)
    parts = list(chunks(batches, 100, 2000))
    assert [x for p in parts for x in p["t"].to_pylist()] == texts
    assert all(p.num_rows <= 100 and p.nbytes <= 8000 for p in parts)
    assert list(chunks([], 5)) == []


def test_one_key_with_one_member_in_many_chunks(spark, rows):
    # 900 chunks of 4 rows, all of one key: two thirds of one member, the rest without any but for a few
    src = [("hot", ("m", "m", None, f"x{i % 5}" if i % 40 == 3 else "m")[i % 4], i) for i in range(3600)] + [("k", "m", 1)]
    df = spark.createDataFrame(src, "key string, member string, measure int").repartition(7)
    assert rows(tree_aggregate(df, "key", "member", "measure", chunk_rows=4, fan_in=3, share=10)) == model(src)


def test_fan_in_takes_few_states(spark):
    states = spark.range(1000).select(F.lit("k").alias("key"), F.lit(None).cast("string").alias("member"), F.lit(2).cast("long").alias("n_rows"), F.col("id").alias("largest"), F.col("id").alias("chunk"))
    per = states.groupBy("key", "member", F.expr("chunk div 8")).count()
    assert per.agg(F.max("count")).first()[0] == 8
    assert [tuple(r) for r in fan_in_pairs(states, 1000, 8).collect()] == [("k", None, 2000, 999)]
    assert [tuple(r) for r in fan_in_pairs(states.where("chunk = 0"), 1, 8).collect()] == [("k", None, 2, 0)]


def test_hot_keys_are_few_by_arithmetic(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise(F.col("id").cast("string")).alias("k"))
    assert len(hot_keys(df, "k", share=3)) == 1 and hot_keys(df, "k", share=1) == [] and hot_keys(df.where("false"), "k", share=3) == []
    assert hot_keys(df, "k") == []  # 2,000 rows are not worth splitting
    assert [hot_rows(spark, n) for n in (10**6, 10**9)] == [1 << 17, 10**6 + 1]
