"""Editing and querying of edge tables ``(src, edge_type, dst, overlap)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["src", "edge_type", "dst", "overlap"]
#: Links that one list holds, about; a longer one comes in parts.
LIST = 1 << 18


def has_edge(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (src, edge_type, dst and, if it has the column, overlap) with ``found``."""
    keys = [c for c in EDGE if c in wanted.columns]
    there = edges.select(*keys).distinct().withColumn("_there", F.lit(True))
    return wanted.join(there, keys, "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def get_edge(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first edge (that of the smallest overlap) for each wanted (src, edge_type,
    dst): ``(src, edge_type, dst, dir, dist, oval_size)``; no row if there is none."""
    first = edges.groupBy("src", "edge_type", "dst").agg(F.min("overlap").alias("oval_size"))
    hit = wanted.select("src", "edge_type", "dst").distinct().join(first, ["src", "edge_type", "dst"])
    return hit.select("src", "edge_type", "dst", F.substring("edge_type", 2, 1).alias("dir"), F.lit(1).alias("dist"), "oval_size")


def _numbered(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with their number among those of equal keys."""
    order = [c for c in EDGE if c not in keys] or keys
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def remove_link(edges: DataFrame, gone: DataFrame, missing: str = "error") -> DataFrame:
    """Edges without the first match of each row of ``gone`` (src, edge_type, dst and,
    if it has the column, overlap). A row without a match is an error, or is passed
    over if ``missing`` is ``ignore``."""
    keys = [c for c in EDGE if c in gone.columns]
    mark = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    if missing == "error":
        lost = mark.join(edges.select(*keys), keys, "left_anti")
        if not lost.isEmpty():
            raise ValueError("links to remove that are not there")
    joined = _numbered(edges, keys).join(mark, keys, "left")
    return joined.where("_gone is null or _n > 1").select(*EDGE)


def replace_link(edges: DataFrame, change: DataFrame, by_overlap: bool = False) -> DataFrame:
    """Edges with all matches of each row of ``change`` (src, old_type, old_dst,
    old_overlap, new_type, new_dst, new_overlap) removed and its new link added once.
    Matches are by node, or by node and overlap; a row without one is an error."""
    keys = ["src", "edge_type", "dst"] + ["overlap"] * by_overlap
    old = change.select("src", F.col("old_type").alias("edge_type"), F.col("old_dst").alias("dst"), F.col("old_overlap").alias("overlap")).select(*keys).distinct()
    if not old.join(edges.select(*keys), keys, "left_anti").isEmpty():
        raise ValueError("links to replace that are not there")
    new = change.select("src", F.col("new_type").alias("edge_type"), F.col("new_dst").alias("dst"), F.col("new_overlap").alias("overlap"))
    return edges.select(*EDGE).join(old, keys, "left_anti").select(*EDGE).unionByName(new)


def _in_parts(items: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``items`` with ``part``: groups of more than ``most`` rows are dealt over as many parts as
    they have times ``most`` rows, by the other columns; all others are part 0."""
    large = items.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_parts > 1")
    rest = [c for c in items.columns if c not in keys]
    part = F.pmod(F.xxhash64(*rest), F.coalesce("_parts", F.lit(1))).cast("int")
    return items.join(large, keys, "left").select(*items.columns, part.alias("part"))


def contained_reads(edges: DataFrame, most: int = LIST) -> DataFrame:
    """``(id, contained)``: the sorted neighbours over edges of negative overlap; nodes without one have no
    row, one of more than ``most`` has several."""
    inside = _in_parts(edges.where("overlap < 0").select(F.col("src").alias("id"), "dst", "edge_type", "overlap"), ["id"], most)
    return inside.groupBy("id", "part").agg(F.sort_array(F.collect_list("dst")).alias("contained")).drop("part")


def black_degree(black: DataFrame) -> DataFrame:
    """``(id, dir, blkdegree)`` over black edges ``(id, con, node_id, ...)``."""
    plain = black.where(F.col("con").isin("ff", "fr", "rf", "rr"))
    return plain.groupBy("id", F.substring("con", 1, 1).alias("dir")).agg(F.count("*").alias("blkdegree"))


def _plain(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_type").isin("ff", "fr", "rf", "rr")).select(F.col("src").alias("id"), F.substring("edge_type", 1, 1).alias("dir"), F.col("dst").alias("node_id"))


def _marked(marks: DataFrame) -> DataFrame:
    return marks.where(F.col("con").isin("ff", "fr", "rf", "rr")).select("id", F.substring("con", 1, 1).alias("dir"), "node_id").distinct()


def _each_dir(nodes: DataFrame) -> DataFrame:
    return nodes.select("id").distinct().select("id", F.explode(F.array(F.lit("f"), F.lit("r"))).alias("dir"))


def is_black(nodes: DataFrame, edges: DataFrame, black: DataFrame) -> DataFrame:
    """``(id, dir, black)``: whether each edge of the direction leads to a node that a
    black edge of it leads to; true without edges."""
    open_ = _plain(edges).join(_marked(black), ["id", "dir", "node_id"], "left_anti").select("id", "dir").distinct().withColumn("_open", F.lit(True))
    return _each_dir(nodes).join(open_, ["id", "dir"], "left").select("id", "dir", F.col("_open").isNull().alias("black"))


def is_gray(nodes: DataFrame, edges: DataFrame, black: DataFrame, gray: DataFrame) -> DataFrame:
    """``(id, dir, gray)``: whether some edge of the other direction leads to a node that
    a gray or black edge of that direction leads to."""
    marks = _marked(black.select("id", "con", "node_id").unionByName(gray.select("id", "con", "node_id")))
    hit = _plain(edges).join(marks, ["id", "dir", "node_id"], "left_semi").select("id", "dir").distinct()
    turned = hit.select("id", F.when(F.col("dir") == "f", "r").otherwise("f").alias("dir"), F.lit(True).alias("_hit"))
    return _each_dir(nodes).join(turned, ["id", "dir"], "left").select("id", "dir", F.col("_hit").isNotNull().alias("gray"))


def keep_black(black: DataFrame, direction: str) -> DataFrame:
    """Black edges of one direction, each judged by its own type."""
    return black.where(F.substring("con", 1, 1) == direction)


def clear_black(black: DataFrame, direction: str) -> DataFrame:
    """Black edges without those of one direction."""
    return black.where(F.substring("con", 1, 1) != direction)


def count_pair_ends(a: DataFrame, b: DataFrame, group: str = "id", name: str = "name") -> DataFrame:
    """``(group, pair_ends)``: how many names of a, repeated ones too, have their mate
    among the names of b in the same group; groups of a without any have 0."""
    from strandloom.functions.dna import mate_name

    mates = b.select(group, F.col(name).alias("_mate")).distinct().withColumn("_hit", F.lit(1))
    met = a.select(group, mate_name(name).alias("_mate")).join(mates, [group, "_mate"], "left")
    return met.groupBy(group).agg(F.count("_hit").alias("pair_ends"))


def merged_lists(edges: DataFrame, most: int = LIST) -> DataFrame:
    """``(src, edge_type, part, links)``: the links of each node and type as sorted texts
    ``dst!overlap``, for node lines. A list of more than ``most`` links comes in parts, each in a row
    of its own, so a hub is never gathered as a whole; all others are part 0."""
    from strandloom.functions.dna import edge_text

    dealt = _in_parts(edges.select(*EDGE), ["src", "edge_type"], most)
    return dealt.groupBy("src", "edge_type", "part").agg(F.sort_array(F.collect_list(edge_text("dst", "overlap"))).alias("links"))
