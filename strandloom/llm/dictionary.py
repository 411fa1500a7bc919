"""Duplicates hidden by formatting: dictionary-encoded columns and compact integer tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import hot_keys, salted_lookup
from strandloom.session import write_table


def letters(c: Column | str) -> Column:
    """Upper-cased text without all characters but A to Z."""
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def holds_base(content: Column) -> Column:
    return content.rlike("[ACGT]")


def dictionary(df: DataFrame, fields: list[str]) -> DataFrame:
    """``(value, value_id)`` for each distinct value of the fields that holds a base:
    each is canonicalised once, and values of equal content share an integer."""
    values = None
    for c in fields:
        one = df.select(F.col(c).cast("string").alias("value")).where("value is not null").distinct()
        values = one if values is None else values.unionByName(one)
    canonical = values.distinct().select("value", letters("value").alias("content")).where(holds_base(F.col("content")))
    canonical, _ = write_table(canonical, "values")
    # written once: the numbers must not change if a task runs again
    numbered, _ = write_table(canonical.select("content").distinct().withColumn("value_id", F.monotonically_increasing_id()), "ids")
    # one content may be written in any number of ways, so it may be a hot key here
    return salted_lookup(canonical, numbered, "content").select("value", "value_id")


def collapse(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(keep, copies)``: the smallest key and the number of rows of each group of
    records whose fields are equal in content, in any order of the fields.

    Records with a null key, a null field or a field without a base are left out. Equal writings
    are counted before anything is shuffled by value, the fields are rewritten as
    integers through the dictionary (hot values are salted), and the sorted tuples
    are grouped. An empty table gives no rows; ties are resolved by the key.
    """
    t = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *(F.col(c).cast("string").alias(f"_f{i}") for i, c in enumerate(fields)))
    fields = [f"_f{i}" for i in range(len(fields))]
    for c in fields:
        t = t.where(F.col(c).isNotNull())
    written, _ = write_table(t.groupBy(*fields).agg(F.count("*").alias("copies"), F.min("_key").alias("keep")), "written")
    words, _ = write_table(dictionary(written, fields), "dictionary")
    hot = {c: hot_keys(written, c) for c in fields}
    for i, c in enumerate(fields):
        lookup = words.select(F.col("value").alias(c), F.col("value_id").alias(f"_v{i}"))
        written = salted_lookup(written, lookup, c, hot=hot[c]).drop(c)
    tuples = written.withColumn("tuple", F.sort_array(F.array(*(F.col(f"_v{i}") for i in range(len(fields))))))
    return tuples.groupBy("tuple").agg(F.min("keep").alias("keep"), F.sum("copies").alias("copies")).drop("tuple")


def copies(pairs: DataFrame) -> DataFrame:
    """Groups of two or more read pairs with the same mates, in either order."""
    return collapse(pairs, "read_no", ["seq_f", "seq_r"]).where("copies > 1").select(F.col("keep").alias("keep_no"), "copies")
