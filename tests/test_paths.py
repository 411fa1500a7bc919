import random

from strandloom.operators.paths import find_tails, tails

EDGES = "src string, edge_type string, dst string, overlap int"
BLACK = "id string, con string"


def walk_all(nodes, edges, black):
    out = {}
    for s, t, d, n in edges:
        if t in ("ff", "fr", "rf", "rr"):
            out.setdefault((s, t[0]), []).append((d, t[1], n))
    dark = {(i, c[0]) for i, c in black}

    def tail(x, d):
        e = out.get((x, d), [])
        return e[0] if len(e) == 1 and (x, d) not in dark else None

    flip = {"f": "r", "r": "f"}
    got = set()
    for start in nodes:
        for d0 in "fr":
            seen, cur, d, dist, size = {start}, start, d0, 0, 0
            while (nxt := tail(cur, d)) and nxt[0] in nodes and nxt[0] not in seen:
                seen.add(nxt[0])
                back = tail(nxt[0], flip[nxt[1]])
                if any(i == nxt[0] for i, _ in black) or not back or back[0] != cur:
                    break
                cur, d, size = nxt
                dist += 1
            got.add((start, d0, cur, flip[d], dist, size))
    return got


def link(a, d, b, e, n):
    """An edge and the one that leads back."""
    flip = {"f": "r", "r": "f"}
    return [(a, d + e, b, n), (b, flip[e] + flip[d], a, n)]


def shapes():
    yield "chain", [e for i in range(40) for e in link(f"n{i}", "f", f"n{i + 1}", "f", i)], []
    yield "cycle", [e for i in range(7) for e in link(f"n{i}", "f", f"n{(i + 1) % 7}", "f", i)], []
    yield "cycle of two", link("a", "f", "b", "f", 1) + link("b", "f", "a", "f", 2), []
    yield "turned", [e for i in range(9) for e in link(f"n{i}", "fr"[i % 2], f"n{i + 1}", "fr"[(i + 1) % 2], i)], []
    yield "hairpin", [e for i in range(5) for e in link(f"n{i}", "f", f"n{i + 1}", "f", i)] + [("n5", "fr", "n5", 9)], []
    yield "hairpins at both ends", [e for i in range(4) for e in link(f"n{i}", "f", f"n{i + 1}", "f", i)] + [("n4", "fr", "n4", 9), ("n0", "rf", "n0", 8)], []
    yield "both ways to one", [("w", "ff", "y", 1), ("w", "rf", "y", 2), ("y", "rf", "w", 3)], []
    yield "both ways back", [("w", "ff", "y", 1), ("w", "rf", "y", 2), ("y", "rf", "w", 3), ("y", "fr", "w", 4)], []
    yield "branch", link("a", "f", "b", "f", 1) + link("b", "f", "c", "f", 2) + [("b", "ff", "d", 3)], []
    yield "black", [e for i in range(6) for e in link(f"n{i}", "f", f"n{i + 1}", "f", i)], [("n3", "ff")]
    yield "e types", [("a", "fe", "b", 1), ("a", "ff", "c", 2), ("c", "rr", "a", 2)], []


def nodes_of(edges):
    return sorted({x for s, _, d, _ in edges for x in (s, d)})


def test_shapes(spark):
    """All shapes as parts of one graph."""
    edges, black = [], []
    for name, own, dark in shapes():
        edges += [(f"{name} {a}", t, f"{name} {b}", n) for a, t, b, n in own]
        black += [(f"{name} {a}", c) for a, c in dark]
    nodes = nodes_of(edges)
    got = find_tails(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, EDGES), spark.createDataFrame(black, BLACK))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == walk_all(nodes, edges, black) and len(rows) == 2 * len(nodes)


def test_random_graphs(spark):
    rng = random.Random(3)
    edges, nodes = [], []
    for g in range(60):  # many small graphs at once, some over few nodes so that odd turns are common
        own = [f"g{g}n{i}" for i in range(rng.choice([2, 3, 5, 12]))]
        nodes += own
        for _ in range(rng.randrange(1, 2 * len(own) + 1)):
            a, b = rng.choice(own), rng.choice(own)
            e = link(a, rng.choice("fr"), b, rng.choice("fr"), rng.randrange(20, 60))
            edges += e if rng.random() < 0.8 else e[:1]
    known = nodes[:-5]  # some ends are not among the nodes
    edges = sorted(set(edges))
    got = find_tails(spark.createDataFrame([(n,) for n in known], "id string"), spark.createDataFrame(edges, EDGES))
    want = walk_all(set(known), edges, [])
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want)
    assert set(rows) == want


def test_no_edges(spark, rows):
    n = spark.createDataFrame([("a",)], "id string")
    assert rows(find_tails(n, spark.createDataFrame([], EDGES))) == [("a", "f", "a", "r", 0, 0), ("a", "r", "a", "f", 0, 0)]
    assert tails(spark.createDataFrame([], EDGES)).collect() == []


def test_ways_into_a_cycle(spark):
    """A cycle entered from aside that has a third node, and many small graphs of one-sided links."""
    edges = [("A", "ff", "P", 1), ("A", "rf", "P", 2), ("P", "rr", "A", 3), ("P", "ff", "U", 4), ("U", "rf", "P", 5), ("U", "fr", "P", 6)]
    edges += [("Z", "ff", "Z", 1), ("Z", "rf", "Z", 2)]  # into a cycle of the same node
    rng = random.Random(8)
    for g in range(1500):
        own = [f"g{g}n{i}" for i in range(rng.choice([1, 2, 3, 4]))]
        for x in own:
            for d in "fr":
                if rng.random() < 0.9:
                    edges.append((x, d + rng.choice("fr"), rng.choice(own), rng.randrange(20, 60)))
    nodes = nodes_of(edges)
    got = find_tails(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, EDGES))
    rows = [tuple(r) for r in got.collect()]
    want = walk_all(nodes, edges, [])
    assert ("A", "f", "U", "r", 2, 4) in rows
    assert len(rows) == 2 * len(nodes)
    assert set(rows) == want


def test_turns_by_blocks_equal_those_of_the_whole_line(spark):
    from strandloom.operators.paths import _next_turn

    rng = random.Random(9)
    src = [(line, pos, rng.randrange(-50, 200) if rng.random() < 0.2 else None) for line in "ab" for pos in range(-40, 90) if rng.random() < 0.8]
    got = {(r["line"], r["pos"]): r["stop"] for r in _next_turn(spark.createDataFrame(src, "line string, pos long, turn long"), 7).collect()}
    want = {(a, p): min((t for b, q, t in src if b == a and q >= p and t is not None), default=None) for a, p, _ in src}
    assert got == want
