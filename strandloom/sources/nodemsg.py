"""Node lines: tab-separated records of self-describing fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.dna import EDGE_TYPES, encode_dna, two_places

#: Codes of the optional list fields, in the order in which they are written, with
#: the columns that hold them (fixed values).
LIST_FIELDS = (
    ("cf", "can_compress_f"), ("cr", "can_compress_r"), ("u", "is_unique"), ("m", "merge_dir"), ("r", "replacement"), ("t", "mertag"),
    ("p", "bubbles"), ("n", "contained"), ("I", "attributes"), ("f", "mates"), ("e", "removal_edges"), ("a", "adjust_edges"), ("x", "merged_tips"),
    ("0", "fcolor"), ("1", "rcolor"), ("g", "gray_edges"), ("b", "black_edges"),
)


def node_lines(nodes: DataFrame) -> DataFrame:
    """``(id, line)`` of nodes ``(id, seq_f, seq_r, cov)`` with any of the columns of
    LIST_FIELDS and an ``edges`` map from type to list. Absent and null columns and
    empty lists are not written, nor are *s without either read and *v without a coverage;
    one null read of the two is written as an empty one, so the mark between them stays. An id or value with a tab, or a value that begins
    with ``*``, cannot be written and is an error."""
    have = dict(nodes.dtypes)
    pair = F.concat_ws("!", *(F.coalesce(encode_dna(c), F.lit("")) for c in ("seq_f", "seq_r")))
    parts = [
        F.col("id"), F.lit("N"), F.when(F.col("seq_f").isNotNull() | F.col("seq_r").isNotNull(), F.concat_ws("\t", F.lit("*s"), pair)),
        F.when(F.col("cov").isNotNull(), F.concat_ws("\t", F.lit("*v"), two_places("cov"))),
    ]

    def field(code: str, values):
        bad = F.exists(values, lambda x: x.contains("\t") | x.startswith("*"))
        shown = F.when(bad, F.raise_error(F.lit("a value cannot be written in a node line"))).otherwise(F.concat_ws("\t", F.lit("*" + code), values))
        return F.when(values.isNull() | (F.size(values) <= 0), F.lit(None).cast("string")).otherwise(shown)

    if "edges" in have:
        parts += [field(t, F.try_element_at("edges", F.lit(t))) for t in EDGE_TYPES]
    for code, column in LIST_FIELDS:
        if column not in have:
            continue
        c = F.col(column)
        if have[column] == "boolean":
            c = F.when(c, F.array(F.lit("1")))
        elif not have[column].startswith("array"):
            c = F.when(c.isNotNull(), F.array(c.cast("string")))
        parts.append(field(code, c))
    safe = F.when(F.col("id").contains("\t"), F.raise_error(F.lit("an id cannot be written in a node line"))).otherwise(F.concat_ws("\t", *parts))
    return nodes.select("id", safe.alias("line"))


def parse_node_lines(lines: DataFrame, line: str = "line", only: list[str] | None = None) -> DataFrame:
    """``(id, fields)`` of node lines, fields being a map from code to values. A field
    opened again goes on with its list; with ``only``, other fields are left out and
    the tag is not checked, else a tag other than N is an error."""
    s = lines.select(F.split(line, "\t\\*").alias("p")).select(F.split(F.col("p")[0], "\t").alias("head"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("p"))
    opened = F.transform("p", lambda x: F.struct(F.split(x, "\t")[0].alias("code"), F.slice(F.split(x, "\t"), 2, F.greatest(F.size(F.split(x, "\t")) - 1, F.lit(0))).alias("v")))
    s = s.withColumn("p", opened if only is None else F.filter(opened, lambda x: x["code"].isin(only)))
    codes = F.array_distinct(F.transform("p", lambda x: x["code"]))
    values = F.transform(codes, lambda c: F.flatten(F.transform(F.filter("p", lambda x: x["code"] == c), lambda x: x["v"])))
    known = F.map_from_arrays(codes, values)
    if only is None:
        known = F.when(F.get("head", F.lit(1)).eqNullSafe(F.lit("N")), known).otherwise(F.raise_error(F.lit("unknown code in a node line")))
    return s.select(F.col("head")[0].alias("id"), known.alias("fields"))


def write_node_lines(lines: DataFrame, path: str, compression: str | None = None) -> None:
    """Node lines as text files."""
    w = lines.select(F.col("line").alias("value")).write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(path)


def read_node_lines(spark: SparkSession, path: str | list[str], only: list[str] | None = None) -> DataFrame:
    """``(id, fields)`` of node files, plain or compressed, by Spark's own scan; empty lines are passed over."""
    return parse_node_lines(spark.read.text(path).where("value != ''"), "value", only)
