"""Unbranched chains of the overlap graph, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import write_table

#: Places of a line that are sorted together.
BLOCK = 1 << 16


def tails(edges: DataFrame, black: DataFrame | None = None) -> DataFrame:
    """``(id, dir, tail, tail_dir, oval_size)``: the only continuation of a node in a
    direction: it has one edge of the types dir+f and dir+r and no black edge of it."""
    plain = edges.where(F.col("edge_type").isin("ff", "fr", "rf", "rr"))
    one = plain.groupBy(F.col("src").alias("id"), F.substring("edge_type", 1, 1).alias("dir")).agg(
        F.count("*").alias("n"), F.min(F.struct("dst", F.substring("edge_type", 2, 1).alias("d"), "overlap")).alias("e")
    )
    one = one.where("n = 1").select("id", "dir", F.col("e.dst").alias("tail"), F.col("e.d").alias("tail_dir"), F.col("e.overlap").alias("oval_size"))
    if black is not None:
        one = one.join(black.select("id", F.substring("con", 1, 1).alias("dir")).distinct(), ["id", "dir"], "left_anti")
    return one


def _state(node: str, direction: str):
    return F.concat(F.col(direction), F.col(node))


def links(nodes: DataFrame, edges: DataFrame, black: DataFrame | None = None) -> DataFrame:
    """``(s, t, oval_size)`` between states, a state being direction and node: a step
    that the walk may take, because the next node is one of ``nodes``, leads back
    to where the walk stands, and has no black edges."""
    t = tails(edges, black)
    flipped = F.when(F.col("tail_dir") == "f", "r").otherwise("f")
    back = t.select(F.col("id").alias("tail"), F.col("dir").alias("_back"), F.col("tail").alias("_to"))
    ok = t.withColumn("_back", flipped).join(back, ["tail", "_back"]).where("_to = id")
    ok = ok.join(nodes.select(F.col("id").alias("tail")).distinct(), "tail", "left_semi")
    if black is not None:
        ok = ok.join(black.select(F.col("id").alias("tail")).distinct(), "tail", "left_anti")
    return ok.select(_state("id", "dir").alias("s"), _state("tail", "tail_dir").alias("t"), "oval_size")


def _double(jump: DataFrame) -> DataFrame:
    """Every jump followed by the jump of where it ends; a jump that has come to an end stays."""
    nxt = jump.select(F.col("s").alias("t"), F.col("t").alias("_t"), F.col("steps").alias("_n"), F.col("least").alias("_l"), F.col("open").alias("_o"))
    j = jump.where("open").join(nxt, "t", "left").select(
        "s", F.coalesce("_t", "t").alias("t"), (F.col("steps") + F.coalesce("_n", F.lit(0))).alias("steps"),
        F.least("least", "_l").alias("least"), F.coalesce("_o", F.lit(False)).alias("open"),
    )
    return j.unionByName(jump.where("not open"))


def _ranks(link: DataFrame, cyclic: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(s, end, steps)`` of the states whose walk ends, and ``(s, least)`` of the others,
    which run in cycles: least is the smallest state of the cycle. Rounds: the
    logarithm of the longest chain."""
    jump = link.select("s", "t", F.lit(1).cast("long").alias("steps"), F.least("s", "t").alias("least"), F.lit(True).alias("open"))
    jump, _ = write_table(jump, "jumps")
    left = jump.count()
    while left:
        jump, _ = write_table(_double(jump), "jumps")
        now = jump.where("open").count()
        if now == left:  # no chain ends between one and two jumps away, so none ends at all
            break
        left = now
    loops = jump.where("open")
    seen = -1
    while left:
        total = loops.agg(F.sum(F.xxhash64("least").cast("decimal(38,0)")).alias("h")).first()["h"]
        if total == seen:
            break
        seen = total
        loops, _ = write_table(_double(loops), "loops")
    return jump.where("not open").select("s", F.col("t").alias("end"), "steps"), loops.select("s", "least")


def _next_turn(places: DataFrame, block: int = BLOCK) -> DataFrame:
    """Places ``(line, pos, turn, ...)`` with ``stop``, the least turn from the place on. Lines are cut into
    blocks of ``block`` places, so that a long line is not sorted as one: only the least turn of each block is."""
    cut = places.withColumn("_block", F.floor(F.col("pos") / block))
    per = cut.groupBy("line", "_block").agg(F.min("turn").alias("_least"))
    behind = Window.partitionBy("line").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = per.select("line", "_block", F.min("_least").over(behind).alias("_beyond"))
    here = Window.partitionBy("line", "_block").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("_own", F.min("turn").over(here))
    return own.join(beyond, ["line", "_block"]).withColumn("stop", F.least("_own", "_beyond")).drop("_block", "_own", "_beyond")


def find_tails(nodes: DataFrame, edges: DataFrame, black: DataFrame | None = None) -> DataFrame:
    """``(id, dir, tail, tail_dir, dist, oval_size)`` for each node and direction: where
    the walk along only continuations ends, in which direction it looks back, after
    how many steps, and the overlap of the last (0 without a step).

    A walk stops before it would come to a node a second time, in either direction:
    on a cycle at the node before the start, on a chain that turns back at the turn.
    """
    link, _ = write_table(links(nodes, edges, black), "links")
    chains, loops = _ranks(link)
    # on a cycle are those two steps after some state that never ends: ways in from aside are two states long at most
    once = link.join(loops.select("s"), "s").select(F.col("t").alias("s")).distinct()
    on_loop, _ = write_table(link.join(once, "s").select(F.col("t").alias("s")).distinct().join(loops, "s"), "cycles")
    # a cycle is cut before its smallest state and ranked as a chain that starts there
    cut = link.join(on_loop, "s").where("t != least")
    cut_ranks, _ = _ranks(cut.select("s", "t", "oval_size"))
    none = F.lit(0).cast("long")
    ring = on_loop.join(cut_ranks, "s", "left").select("s", F.col("least").alias("line"), F.coalesce("steps", none).alias("to_end"))
    size = ring.groupBy("line").agg(F.count("*").alias("size"))
    ring = ring.join(size, "line").withColumn("pos", F.col("size") - 1 - F.col("to_end"))
    ring = ring.select("s", "line", "pos", "size")
    ends = link.select(F.col("t").alias("s")).distinct().join(link, "s", "left_anti").join(loops, "s", "left_anti").select("s", F.col("s").alias("line"), none.alias("pos"), none.alias("size"))
    line = chains.select("s", F.col("end").alias("line"), (-F.col("steps")).alias("pos"), none.alias("size")).unionByName(ends)
    place, _ = write_table(line.unionByName(ring), "places")

    # the way back to the same node in the other direction, where it lies ahead
    node = F.substring("s", 2, 1_000_000)
    two = place.withColumn("node", node)
    twin = two.select("node", "line", F.col("s").alias("_s2"), F.col("pos").alias("_p2"))
    ahead = two.join(twin, ["node", "line"]).where("s != _s2")
    ahead = ahead.select("s", F.when(F.col("_p2") > F.col("pos"), F.col("_p2")).when(F.col("size") > 0, F.col("_p2") + F.col("size")).alias("turn")).where("turn is not null")
    turning = place.join(ahead, "s", "left")
    turned = turning.join(ahead.join(place, "s").select("line").distinct(), "line", "left_semi")  # only lines with a turn are sorted
    twice = turned.unionByName(turned.where("size > 0").withColumn("pos", F.col("pos") + F.col("size")).withColumn("turn", F.col("turn") + F.col("size")))
    stops = _next_turn(twice).groupBy("s").agg(F.min_by("stop", "pos").alias("stop"))

    walk = place.join(stops, "s", "left")
    last = F.when(F.col("size") > 0, F.col("pos") + F.col("size")).otherwise(F.lit(1).cast("long"))  # one beyond the end
    walk = walk.withColumn("goal", F.least(F.coalesce("stop", last), last) - 1)
    # a state that leads into a cycle without lying on it walks on as its target does, but stops before its own
    # node, which lies on the cycle just before the target
    aside = link.join(place, "s", "left_anti").select("s", "t", "oval_size")
    led = walk.where("size > 0").select(F.col("s").alias("t"), "line", (F.col("pos") - 1).alias("pos"), "size", F.least("goal", F.col("pos") + F.col("size") - 2).alias("goal"))
    walk = walk.select("s", "line", "pos", "size", "goal").unionByName(aside.select("s", "t").join(led, "t").drop("t"))
    walk = walk.select("s", "line", F.when(F.col("size") > 0, F.pmod("goal", "size")).otherwise(F.col("goal")).alias("at"), (F.col("goal") - F.col("pos")).alias("dist"))
    entered = link.groupBy(F.col("t").alias("s")).agg(F.min("oval_size").alias("in_size"))
    target = place.join(entered, "s").select(F.col("s").alias("goal"), "line", F.col("pos").alias("at"), "in_size")
    got = walk.where("dist > 0").join(target, ["line", "at"]).join(link.select("s", F.col("oval_size").alias("own")), "s")
    got = got.select("s", "goal", "dist", F.when(F.col("dist") == 1, F.col("own")).otherwise(F.col("in_size")).alias("oval_size"))
    # one that leads to such a state (the cycle then has two nodes, both passed) stops after one step
    aside = aside.join(place.select(F.col("s").alias("t")), "t", "left_anti").select("s", F.col("t").alias("goal"), F.lit(1).cast("long").alias("dist"), "oval_size")
    moved = got.unionByName(aside)
    every = nodes.select("id").distinct().select("id", F.explode(F.array(F.lit("f"), F.lit("r"))).alias("dir")).withColumn("s", _state("id", "dir"))
    out = every.join(moved, "s", "left").withColumn("goal", F.coalesce("goal", "s"))
    return out.select(
        "id", "dir", F.substring("goal", 2, 1_000_000).alias("tail"), F.when(F.substring("goal", 1, 1) == "f", "r").otherwise("f").alias("tail_dir"),
        F.coalesce("dist", none).alias("dist"), F.coalesce("oval_size", F.lit(0)).cast("int").alias("oval_size"),
    )
