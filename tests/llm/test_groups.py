import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import groups as module
from strandloom.llm.groups import _contracted, _round, grid_size, groups, priority, union_find
from strandloom.operators import skew
from strandloom.session import write_table

SCHEMA = "src string, dst string"


def model(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return sorted((x, root(x)) for x in parent)


def run(spark, links, **how):
    df = spark.createDataFrame(links, SCHEMA)
    for c in ("v", "u", "rep", "least", "root", "a", "name"):
        df = df.withColumn(c, F.lit(1))
    return sorted(tuple(r) for r in groups(df, **how).collect())


def test_union_find():
    rng = np.random.default_rng(1)
    for turn, n in enumerate((1, 5, 60, 400)):
        u, v = rng.integers(0, n, 2 * n // 3 + 1), rng.integers(0, n, 2 * n // 3 + 1)
        group = dict(model(list(zip(map(str, u), map(str, v)))))
        names, rep = union_find(u, v, turn)
        assert len(names) == len(group)
        best = {}
        for x in names:
            g = group[str(x)]
            p = priority(np.array([x]), turn)[0]
            best[g] = min(best.get(g, (p, x)), (p, x))
        assert all(r == best[group[str(x)]][1] for x, r in zip(names, rep))


def test_a_chain_shrinks_whatever_its_order(spark):
    """Every edge alone in its chunk: only the random priorities make a round shorten the chain."""
    n = 600
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    sizes = [n]
    for turn in range(4):
        stars, _ = write_table(_round(edges, 1, 1, turn), "stars")
        edges, _ = write_table(_contracted(stars), "edges")
        sizes.append(edges.count())
    assert all(b < 0.8 * a for a, b in zip(sizes, sizes[1:])), sizes


CASES = {
    "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(200)],
    "backwards": [(f"n{i + 1:03}", f"n{i:03}") for i in range(0, 200, 3)],
    "star around the last": [("z", f"n{i}") for i in range(300)],
    "webs and odd rows": [("a", "b"), ("b", "a"), ("b", "c"), ("x", "x"), (None, "q"), ("q", None), (None, None), ("a", "b"), ("ä", "Z"), ("", "e")],
    "nothing": [],
    "only null ends": [(None, "a")],
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, name):
    assert run(spark, CASES[name], chunk_edges=20) == model(CASES[name])


def test_one_round_and_many_agree(spark):
    rng = random.Random(4)
    links = [(f"n{rng.randrange(900)}", f"n{rng.randrange(900)}") for _ in range(700)] + [("n5", f"h{i}") for i in range(500)]
    want = model(links)
    assert run(spark, links) == want and run(spark, links, chunk_edges=60) == want


def test_the_grid_is_bounded():
    assert [grid_size(n, 8) for n in (1, 70_000, 10**6, 10**8, 10**10, 10**12, 10**15)] == [1, 2, 3, 4, 35, 128, 128]


def test_a_small_grid_with_many_chunks_a_cell(spark, monkeypatch):
    monkeypatch.setattr(module, "grid_size", lambda *a: 2)
    monkeypatch.setattr(skew, "LEAST_ROWS", 1)
    rng = random.Random(6)
    links = [(f"n{rng.randrange(700)}", f"n{rng.randrange(700)}") for _ in range(400)] + [("hub", f"n{i}") for i in range(0, 300, 7)] + [(f"c{i}", f"c{i + 1}") for i in range(150)]
    assert run(spark, links, chunk_edges=16) == model(links)
