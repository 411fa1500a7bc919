"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hot keys that a join knows at least; more where the session has many partitions.
LEAST_SHARE = 1000
#: Rows that a key has at least before it is split.
LEAST_ROWS = 1 << 17


def spread(columns: list[Column | str], parts: int) -> Column:
    """A part number from 0 to parts-1, fixed by the content of ``columns``."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def hot_rows(spark: SparkSession, total: int, share: int | None = None) -> int:
    """Rows from which on a key is hot: 1/share of all. By default share is four times the
    session's shuffle partitions, 1,000 at least, so a hot key fills a quarter of an average
    partition; and keys of fewer than LEAST_ROWS rows are not worth splitting."""
    if share:
        return total // share + 1
    return max(total // max(LEAST_SHARE, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1, LEAST_ROWS)


def hot_keys(df: DataFrame, key: str | list[str], share: int | None = None) -> list[int]:
    """Hashes of the keys that hold ``hot_rows`` or more: fewer than share numbers by arithmetic,
    whatever the table holds. ``df`` is read twice, so it should be a stored table or a narrow view of one."""
    keys = [key] if isinstance(key, str) else key
    total = df.count()
    least = hot_rows(df.sparkSession, total, share)
    if total < least:
        return []
    some = df.dropna(subset=keys).select(F.xxhash64(*keys).alias("_h"))
    return [r["_h"] for r in some.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).collect()]


def salted_lookup(
    facts: DataFrame, lookup: DataFrame, key: str | list[str], salts: int = 64, share: int | None = None, how: str = "inner", hot: list[int] | None = None
) -> DataFrame:
    """``facts`` joined with ``lookup``, which holds each ``key`` (one column or several) at most once.

    Rows of hot keys are dealt over ``salts`` parts by their other columns and the
    lookup's rows of those keys (fewer than ``share``) are repeated once a part;
    all other rows keep salt 0. No row is dropped. Null keys match nothing. ``how``
    is inner or left; ``hot`` gives the hashes of the hot keys where ``hot_keys`` was asked before.
    """
    keys = [key] if isinstance(key, str) else key
    if hot is None:
        hot = hot_keys(facts, keys, share)
    if not hot:
        return facts.join(lookup, keys, how)
    rest = [c for c in facts.columns if c not in keys]
    types = dict(facts.dtypes)  # a hash depends on the type
    is_hot = F.xxhash64(*(F.col(k).cast(types[k]) for k in keys)).isin(hot)
    dealt = facts.withColumn("_salt", F.when(is_hot, spread(rest or keys, salts)).otherwise(F.lit(0)))
    spots = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(lookup.withColumn("_salt", F.explode(spots)), [*keys, "_salt"], how).drop("_salt")
