"""One group identifier for all records linked directly or indirectly."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.vectors import chunks
from strandloom.operators.skew import hot_keys, salted_lookup, spread
from strandloom.session import drop_table, write_table

#: Edges that a task unites at once.
CHUNK_EDGES = 1 << 16
#: Edges of a block of the grid, some 100 MB, and blocks on a side of the grid at most; blocks
#: beyond that grow, which costs no memory, as a task unites them chunk by chunk.
CELL_EDGES, MOST_GRID = 1 << 23, 128


def grid_size(edges: int, cores: int, chunk: int = CHUNK_EDGES) -> int:
    """Blocks on a side of the grid: as many cells as chunks until all cores have one, then one for
    each CELL_EDGES, at most MOST_GRID ** 2 in all."""
    cells = max(min(-(-edges // chunk), cores), -(-edges // CELL_EDGES), 1)
    return min(math.ceil(math.sqrt(cells)), MOST_GRID)


def priority(v: np.ndarray, turn: int) -> np.ndarray:
    """A random order of the vertices, another one each round."""
    x = v.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def union_find(u: np.ndarray, v: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and, for each, the one of least priority that these edges link it to."""
    names = np.unique(np.concatenate([u, v]))
    names = names[np.argsort(priority(names, turn), kind="stable")]
    by_name = np.argsort(names)
    a, b = (by_name[np.searchsorted(names[by_name], x)] for x in (u, v))
    parent = np.arange(len(names))
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return names, names[parent]
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _forest(rows: int, turn: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, rows, 32 << 20):  # 16 bytes an edge
            v, rep = union_find(t["u"].to_numpy(), t["v"].to_numpy(), turn)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(rep), pa.array(priority(rep, turn))], ["v", "rep", "order"])

    return run


def _round(edges: DataFrame, grid: int, rows: int, turn: int) -> DataFrame:
    """``(v, rep, least)``: what a block of the grid, and what all blocks of v's row and
    column together, know as the representative of v."""
    cells = edges.select("u", "v").repartitionById(grid * grid, spread(["u"], grid) * grid + spread(["v"], grid))
    stars = cells.select("u", "v").mapInArrow(_forest(rows, turn), "v long, rep long, order long")
    best = F.min(F.struct("order", "rep")).over(Window.partitionBy("v"))  # as many rows a vertex as chunks hold it
    return stars.select("v", "rep", best["rep"].alias("least"))


def _contracted(stars: DataFrame) -> DataFrame:
    """Edges between the representatives of the vertices that a block knows as linked."""
    own = stars.where("v = rep").select("rep", F.col("least").alias("over")).distinct()
    pairs, _ = write_table(stars.select("rep", "least").distinct(), "pairs")
    joined = salted_lookup(pairs, own, "rep").where("least != over")
    return joined.select(F.least("least", "over").alias("u"), F.greatest("least", "over").alias("v")).distinct()


def groups(links: DataFrame, src: str = "src", dst: str = "dst", chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """``(nodeid, group_id)`` for each node of a link with two ends: the smallest id,
    in byte order, among all nodes linked to it directly or indirectly.

    Vertices are numbered and hashed into blocks of a two-dimensional grid, the cells of which
    are the partitions (see ``grid_size``: 1,225 for 10^10 edges, 16,384 at most). A round
    runs union-find on the edges of every pair of blocks, in chunks of bounded
    size, and exchanges the representatives that a vertex got in its row and column
    of blocks: the one of least priority stands for it. Then edges are drawn
    between representatives only. Priorities are random and change each round, so
    that a quarter of the vertices at least is expected to go in a round, however
    the ids run along a chain; once the edges fit into a chunk, one round ends it.
    At the end the parents of the rounds are followed back. Links of a node to
    itself give a group of one; repeated and mirrored links count once; null ends
    and empty tables give no rows.
    """
    spark = links.sparkSession
    ends = links.select(F.col(src).cast("string").alias("a"), F.col(dst).cast("string").alias("b")).where("a is not null and b is not null").distinct()
    ends, ends_path = write_table(ends, "ends")
    hot = {end: hot_keys(ends, end) for end in ("a", "b")}
    cores = spark.sparkContext.defaultParallelism
    # written once: the numbers must not change if a task runs again
    names = ends.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    names, _ = write_table(names.select("name", F.monotonically_increasing_id().alias("v")), "names")
    for end, v in (("a", "u"), ("b", "v")):
        ends = salted_lookup(ends, names.select(F.col("name").alias(end), F.col("v").alias(v)), end, hot=hot[end]).drop(end)
    edges, path = write_table(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    drop_table(spark, ends_path)
    many = edges.count()
    parents: list[DataFrame] = []
    while many:
        grid = grid_size(many, cores, chunk_edges)
        stars, _ = write_table(_round(edges, grid, chunk_edges, len(parents)), "stars")
        parents.append(stars.select("v", "least").distinct())  # one row a vertex: all its rows name the same least
        if grid == 1 and many <= min(chunk_edges, CHUNK_EDGES):  # one chunk in one cell: all of it is united
            break
        left, left_path = write_table(_contracted(stars), "edges")
        drop_table(spark, path)
        edges, path, many = left, left_path, left.count()
    if not parents:
        return spark.createDataFrame([], "nodeid string, group_id string")
    label = parents.pop().withColumnRenamed("least", "root")
    while parents:
        known = label.select(F.col("v").alias("least"), "root")
        label = salted_lookup(parents.pop(), known, "least", how="left").select("v", F.coalesce("root", "least").alias("root"))
    named, _ = write_table(label.join(names.withColumnRenamed("name", "nodeid"), "v").select("nodeid", "root"), "labels")
    return salted_lookup(named, named.groupBy("root").agg(F.min("nodeid").alias("group_id")), "root").select("nodeid", "group_id")
