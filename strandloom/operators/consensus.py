"""Weighted consensus of sequences that start at the same place, in long form:
characters are counted by group and position, so no group is gathered but for the
string of one character a position that comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.skew import spread

#: Parts of a group that are cut to their first three items by themselves.
PARTS = 64
#: Bases in the order in which shares are tested (fixed values).
ORDER = ("A", "T", "C", "G")


def _shape(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Number of items, and lengths and weights of the first three in the order, of each group. The first
    three of each of ``PARTS`` parts of a group are taken before those of all, so no group is sorted as one."""
    top = items.select(*keys, F.length("seq").alias("_len"), "weight", "seq", *(o.alias(f"_o{i}") for i, o in enumerate(order)), spread([*items.columns], PARTS).alias("_part"))
    by = [f"_o{i}" for i in range(len(order))]
    for w in (Window.partitionBy(*keys, "_part"), Window.partitionBy(*keys)):
        top = top.withColumn("_n", F.row_number().over(w.orderBy(*by))).where("_n <= 3")
    nth = lambda c, i: F.max(F.when(F.col("_n") == i, F.col(c)))
    first = top.groupBy(*keys).agg(
        nth("_len", 2).alias("len2"), nth("_len", 3).alias("len3"), (nth("weight", 1) + nth("weight", 2)).alias("w12"), nth("seq", 1).alias("only")
    )
    return items.groupBy(*keys).agg(F.count("*").alias("items")).join(first, keys)


def _columns(items: DataFrame, lengths: DataFrame, keys: list[str], pick: Column) -> DataFrame:
    """The consensus of each group over its ``len`` first positions, ``pick`` choosing
    the base from the columns A, T, C, G and total."""
    at = items.join(lengths.where("len > 0"), keys).select(*keys, "len", F.col("weight").cast("int").alias("w"), F.posexplode(F.split("seq", "")).alias("pos", "base"))
    sums = at.where("pos < len and base != ''").groupBy(*keys, "pos").agg(
        *(F.sum(F.when(F.col("base") == b, F.col("w")).otherwise(0)).alias(b) for b in ORDER), F.sum("w").alias("total")
    )
    chosen = sums.select(*keys, F.struct("pos", pick.alias("base")).alias("c")).groupBy(*keys).agg(F.sort_array(F.collect_list("c")).alias("c"))
    return chosen.select(*keys, F.array_join(F.col("c.base"), "").alias("consensus"))


def share_above(num: int, den: int, inclusive: bool = False) -> Column:
    """The first base, in the fixed order, whose share of the total is above num/den
    (or equal to it, if inclusive), else N. Compared in whole numbers."""
    out = None
    for b in ORDER:
        left, right = F.col(b) * den, F.col("total") * num
        ok = ((left >= right) & (F.col("total") != 0)) if inclusive else left > right
        out = F.when(ok, F.lit(b)) if out is None else out.when(ok, F.lit(b))
    return out.otherwise(F.lit("N"))


def largest() -> Column:
    """The base of strictly the largest weight, else N."""
    out = None
    for b in ORDER:
        ok = F.col(b) > F.greatest(*(F.col(x) for x in ORDER if x != b))
        out = F.when(ok, F.lit(b)) if out is None else out.when(ok, F.lit(b))
    return out.otherwise(F.lit("N"))


def _consensus(items: DataFrame, pick: Column, third: bool, threshold: tuple[int, int]) -> DataFrame:
    items = items.where("seq is not null").select("grp", "seq", "weight")
    shape = _shape(items, ["grp"], [-F.length("seq"), F.col("seq"), F.col("weight")])
    length = F.when((F.col("items") >= 3) & (F.col("w12") <= 2), F.col("len3")).otherwise(F.col("len2")) if third else F.col("len2")
    shape = shape.select("grp", "items", "only", length.alias("len"))
    many = _columns(items, shape.where("items > 1").select("grp", "len"), ["grp"], pick)
    ns = F.length("consensus") - F.length(F.replace(F.col("consensus"), F.lit("N"), F.lit("")))
    num, den = threshold
    told = F.when(F.col("items") == 1, F.col("only")).when(F.col("len") == 0, F.lit("")).when(ns * den <= F.col("len") * num, F.col("consensus"))
    return shape.join(many, "grp", "left").select("grp", told.alias("consensus"))


def consensus_majority(items: DataFrame, majority: tuple[int, int] = (3, 5), threshold: tuple[int, int] = (1, 2)) -> DataFrame:
    """``(grp, consensus)`` over ``(grp, seq, weight)``.

    Positions run to the length of the second longest sequence, or of the third if
    there are three and the first two weigh 2 or less together. A base needs a
    share above ``majority`` of the weights, cut to whole numbers; else N. Null if
    the share of N is above ``threshold``. One sequence stands for itself; null
    sequences are left out.
    """
    return _consensus(items, share_above(*majority), True, threshold)


def consensus_plurality(items: DataFrame, threshold: tuple[int, int] = (1, 2)) -> DataFrame:
    """As ``consensus_majority``, but over the length of the second longest sequence
    and with the strictly largest weight; ties give N."""
    return _consensus(items, largest(), False, threshold)


def select_black_edge(black: DataFrame, direction: str) -> DataFrame:
    """The black edge to follow: ``(id, con, node_id)`` over black edges ``(id, con,
    node_id, seq, oval_size, cov)``, null fields where none is fit.

    With two edges of the direction or more their overhangs must agree: over the
    length of the second in order of overhang, a base with a share of 0.6 stands,
    else N. Where that length is 20 or more, four N in a row or a share of 0.4 of N
    reject. The edge of the greatest length times coverage is taken. With fewer,
    the edge of the longest overhang is taken if it has the direction.
    """
    b = black.select("id", "con", "node_id", "seq", F.col("oval_size").cast("int").alias("oval_size"), F.col("cov").cast("double").alias("cov"))
    from strandloom.functions.dna import revcomp

    fits = F.col("con").isin(direction + "f", direction + "r")
    reach = F.length("seq") - F.col("oval_size")
    ties = [F.col("node_id"), F.col("con"), F.col("oval_size"), F.col("seq"), F.col("cov")]
    b = b.withColumn("fits", fits)
    last = lambda c: (c.isNull(), -c)  # noqa: E731  the greatest first, nulls at the end
    edge = F.struct("fits", "con", "node_id")
    one = b.groupBy("id").agg(
        F.min_by(edge, F.struct(~F.col("fits"), *last(F.length("seq") * F.col("cov")), *ties)).alias("best"), F.min_by(edge, F.struct(*last(reach), *ties)).alias("first")
    )
    oriented = F.when(F.substring("con", 2, 1) == "r", revcomp("seq")).otherwise(F.col("seq"))
    own = b.where("fits").select(
        "id", F.substring(oriented, F.col("oval_size") + 1, F.length(oriented)).alias("seq"), F.col("cov").alias("weight"),
        *(c.alias(f"_t{i}") for i, c in enumerate((*last(reach), *ties))),
    )
    shape = _shape(own, ["id"], [F.col(f"_t{i}") for i in range(len(ties) + 2)]).select("id", "items", F.col("len2").alias("len"))
    cons = _columns(own.select("id", "seq", "weight"), shape.where("items > 1").select("id", "len"), ["id"], share_above(3, 5, inclusive=True))
    ns = F.length("consensus") - F.length(F.replace(F.col("consensus"), F.lit("N"), F.lit("")))
    bad = (F.col("len") >= 20) & (F.contains(F.col("consensus"), F.lit("NNNN")) | (ns * 5 >= F.col("len") * 2))
    verdict = shape.join(cons, "id", "left").select("id", "items", F.coalesce(bad, F.lit(False)).alias("bad"))
    told = one.join(verdict, "id", "left")
    many = F.coalesce(F.col("items"), F.lit(0)) > 1
    pick = F.when(many & ~F.col("bad"), F.col("best")).when(~many & F.col("first.fits"), F.col("first"))
    return told.select("id", pick.alias("p")).select("id", F.col("p.con").alias("con"), F.col("p.node_id").alias("node_id"))
