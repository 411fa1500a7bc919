"""Per-key results over few keys that hold most rows: multi-level tree aggregation."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.vectors import chunks
from strandloom.operators.skew import hot_rows, spread
from strandloom.session import write_table

#: Rows that a task combines at once before anything is shuffled.
CHUNK_ROWS = 1 << 16
#: States that one merge of the tree takes in for a key.
FAN_IN = 32


def _combine(rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, t in enumerate(chunks(batches, rows, 32 << 20)):
            t = t.append_column("n_rows", pa.array([1] * t.num_rows, pa.int64()))
            g = t.group_by(["key", "member"], use_threads=False).aggregate([("n_rows", "sum"), ("measure", "max")])
            g = g.select(["key", "member", "n_rows_sum", "measure_max"]).rename_columns(["key", "member", "n_rows", "largest"])
            for i, (name, value) in enumerate((("part", part), ("nth", nth))):
                g = g.add_column(i, name, pa.array([value] * g.num_rows, pa.int32()))
            yield from g.to_batches()

    return run


def fan_in_pairs(states: DataFrame, n_chunks: int, fan_in: int) -> DataFrame:
    """One state ``(key, member, n_rows, largest)`` for each key and member from their
    states in ``n_chunks`` numbered chunks: rounds merge those of ``fan_in`` neighbouring
    chunks, so no reducer gets more than ``fan_in`` states of a pair."""
    while n_chunks > 1:
        n_chunks = -(-n_chunks // fan_in)
        up = states.withColumn("chunk", F.expr(f"chunk div {fan_in}"))
        states = up.groupBy("key", "member", "chunk").agg(F.sum("n_rows").alias("n_rows"), F.max("largest").alias("largest"))
    return states.select("key", "member", "n_rows", "largest")


def tree_aggregate(
    df: DataFrame, key: str, member: str, measure: str, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, share: int | None = None
) -> DataFrame:
    """``(key, n_rows, n_members, largest)`` for each non-null key.

    n_rows counts the key's rows, n_members its distinct non-null members,
    largest is the greatest measure (null if it has none).

    1. Chunks of ``chunk_rows`` rows are combined where they are read, to one
       state for each key and member of the chunk; these states are written.
    2. A key and member (or a key without member) that holds ``hot_rows`` or more (by ``share``) is
       merged by itself: rounds over ``fan_in`` neighbouring chunks leave one state. Such pairs
       are few by arithmetic, as in ``hot_keys``. Of any other pair a reducer gets one
       state a chunk at most, where a chunk has thousands.
    3. The states of a key are dealt over as many slots as the input has
       chunks, by the hash of the member, so that equal members meet and no
       reducer gets more than about a chunk's worth of one key.
    4. Rounds merge ``fan_in`` neighbouring slots into one until one is left,
       log(chunks) rounds in all. A state has fixed size: members never move
       after step 3.

    An empty table gives no rows; rows with a null key are left out; a key
    with null members only has n_members 0; repeated rows count in n_rows.
    """
    t = df.select(
        F.col(key).alias("key"), F.col(member).cast("string").alias("member"), F.col(measure).cast("long").alias("measure")
    ).where(F.col("key").isNotNull())
    schema = f"part int, nth int, key {dict(t.dtypes)['key']}, member string, n_rows long, largest long"
    level0, _ = write_table(t.mapInArrow(_combine(chunk_rows), schema), "chunks")
    total, parts, deep = level0.agg(F.sum("n_rows"), F.max("part"), F.max("nth")).first()
    if total is None:
        return level0.select("key", "n_rows", F.col("n_rows").alias("n_members"), "largest")
    slots = -(-total // chunk_rows)
    pair = F.xxhash64("key", "member")
    least = hot_rows(df.sparkSession, total, share)
    # a pair of that share has many rows in some chunk, so only such states are counted here
    counts = level0.where(F.col("n_rows") >= max(2, chunk_rows // 2048)).groupBy(pair.alias("pair")).agg(F.sum("n_rows").alias("n"))
    hot = [r["pair"] for r in counts.where(F.col("n") >= least).collect()] if total >= least else []
    states = level0.drop("part", "nth")
    if hot:
        wide = fan_in ** math.ceil(math.log(deep + 1, fan_in)) if deep else 1
        numbered = level0.where(pair.isin(hot)).withColumn("chunk", F.col("part").cast("long") * wide + F.col("nth"))
        states = states.where(~pair.isin(hot)).unionByName(fan_in_pairs(numbered.drop("part", "nth"), (parts + 1) * wide, fan_in))
    state = (
        states.withColumn("slot", spread(["key", F.coalesce("member", F.lit(""))], slots))
        .repartition("key", "slot")
        .groupBy("key", "slot", "member")
        .agg(F.sum("n_rows").alias("n_rows"), F.max("largest").alias("largest"))
        .groupBy("key", "slot")
        .agg(F.sum("n_rows").alias("n_rows"), F.count("member").alias("n_members"), F.max("largest").alias("largest"))
    )
    while slots > 1:
        slots = -(-slots // fan_in)
        up = state.withColumn("slot", F.expr(f"slot div {fan_in}").cast("int")) if slots > 1 else state.drop("slot")
        state = up.groupBy("key", *(["slot"] if slots > 1 else [])).agg(
            F.sum("n_rows").alias("n_rows"), F.sum("n_members").alias("n_members"), F.max("largest").alias("largest")
        )
    return state.select("key", "n_rows", "n_members", "largest")


def prefix_stats(occurrences: DataFrame) -> DataFrame:
    """Rows, distinct ids and longest overlap of each canonical prefix (the smaller
    of the prefix and its reverse complement, in upper case); rows without either
    are left out."""
    t = occurrences.select("kmer", "kmer_r", "id", "overlap").where("kmer is not null and kmer_r is not null")
    t = t.select(F.least(F.upper("kmer"), F.upper("kmer_r")).alias("kmer_key"), "id", "overlap")
    s = tree_aggregate(t, "kmer_key", "id", "overlap")
    return s.select(
        F.col("key").alias("kmer_key"), "n_rows", F.col("n_members").alias("n_ids"), F.col("largest").cast("int").alias("max_overlap")
    )
