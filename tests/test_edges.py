import pytest
from pyspark.sql import functions as F

from strandloom.operators import consensus as c
from strandloom.operators import edges as e
from strandloom.sources.nodemsg import node_lines, parse_node_lines

SCHEMA = "src string, edge_type string, dst string, overlap int"
TABLE = [("a", "ff", "b", 30), ("a", "ff", "b", 20), ("a", "fr", "b", 20), ("a", "ff", "c", 20), ("b", "rr", "a", -3), ("b", "rr", "d", -1), ("c", "fe", "a", 9)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(TABLE, SCHEMA)


def test_lookup(spark, table, rows):
    want = spark.createDataFrame([("a", "ff", "b", 20), ("a", "ff", "b", 21), ("z", "ff", "b", 20)], SCHEMA)
    assert [r[-1] for r in rows(e.has_edge(table, want))] == [True, False, False]
    assert [r[-1] for r in rows(e.has_edge(table, want.drop("overlap")))] == [True, True, False]
    assert rows(e.get_edge(table, want)) == [("a", "ff", "b", "f", 1, 20)]


def test_removal(spark, table, rows):
    gone = spark.createDataFrame([("a", "ff", "b")], "src string, edge_type string, dst string")
    assert set(rows(e.remove_link(table, gone))) == set(TABLE) - {("a", "ff", "b", 20)}
    exact = spark.createDataFrame([("a", "ff", "b", 30)], SCHEMA)
    assert set(rows(e.remove_link(table, exact))) == set(TABLE) - {("a", "ff", "b", 30)}
    twice = table.unionByName(table)
    assert len(rows(e.remove_link(twice, exact))) == 2 * len(TABLE) - 1
    absent = spark.createDataFrame([("a", "ff", "b", 99)], SCHEMA)
    with pytest.raises(ValueError):
        e.remove_link(table, absent)
    assert set(rows(e.remove_link(table, absent, missing="ignore"))) == set(TABLE)


def test_replacement(spark, table, rows):
    schema = "src string, old_type string, old_dst string, old_overlap int, new_type string, new_dst string, new_overlap int"
    change = spark.createDataFrame([("a", "ff", "b", 20, "fr", "x", 7)], schema)
    new = ("a", "fr", "x", 7)
    assert set(rows(e.replace_link(table, change))) == set(TABLE) - set(TABLE[:2]) | {new}
    assert set(rows(e.replace_link(table, change, by_overlap=True))) == set(TABLE) - {TABLE[1]} | {new}
    with pytest.raises(ValueError):
        e.replace_link(table, spark.createDataFrame([("a", "ff", "b", 5, "fr", "x", 7)], schema), by_overlap=True)


def test_marks(spark, table, rows):
    assert rows(e.contained_reads(table)) == [("b", ["a", "d"])]
    nodes = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    black = spark.createDataFrame([("a", "ff", "b"), ("a", "fr", "c"), ("b", "rr", "a"), ("b", "er", "d")], "id string, con string, node_id string")
    gray = spark.createDataFrame([("b", "rf", "d")], "id string, con string, node_id string")
    assert rows(e.black_degree(black)) == [("a", "f", 2), ("b", "r", 1)]
    assert rows(e.is_black(nodes, table, black)) == [("a", "f", True), ("a", "r", True), ("b", "f", True), ("b", "r", False), ("z", "f", True), ("z", "r", True)]
    assert [r[:2] for r in rows(e.is_gray(nodes, table, black, gray)) if r[2]] == [("a", "r"), ("b", "f")]
    assert rows(e.keep_black(black, "f")) == rows(black.limit(2)) and len(rows(e.clear_black(black, "f"))) == 2


def test_pair_ends(spark, rows):
    s = "id string, name string"
    a = spark.createDataFrame([("g", "x_1"), ("g", "x_1"), ("g", "y_2"), ("h", "x_1"), ("h", "odd")], s)
    b = spark.createDataFrame([("g", "x_2"), ("g", "x_2"), ("h", "y_1")], s)
    assert rows(e.count_pair_ends(a, b)) == [("g", 2), ("h", 0)]


def cons(spark, rows, f, items, *how):
    return rows(f(spark.createDataFrame(items, "grp string, seq string, weight float"), *how))


def test_consensus(spark, rows):
    one = [("g", "ACG", 1.0)]
    assert cons(spark, rows, c.consensus_majority, one) == cons(spark, rows, c.consensus_plurality, one) == [("g", "ACG")]
    tie = [("g", "AA", 1.0), ("g", "TA", 1.0)]
    assert cons(spark, rows, c.consensus_plurality, tie, (1, 2)) == [("g", "NA")]
    assert cons(spark, rows, c.consensus_plurality, tie, (2, 5)) == [("g", None)]
    share = [("g", "AA", 3.9), ("g", "TA", 2.0)]  # 3 of 5: not above 0.6
    assert cons(spark, rows, c.consensus_majority, share, (3, 5), (1, 1)) == [("g", "NA")]
    three = [("g", "ACGT", 1.0), ("g", "ACG", 1.0), ("g", "AC", 1.0)]
    assert cons(spark, rows, c.consensus_majority, three) == [("g", "AC")]
    heavy = [("g", "ACGT", 1.5), ("g", "ACG", 1.0), ("g", "AC", 1.0), ("h", None, 1.0), ("i", "", 1.0), ("i", "AC", 1.0)]
    assert cons(spark, rows, c.consensus_majority, heavy) == [("g", "ACG"), ("i", "")]
    assert cons(spark, rows, c.consensus_majority, []) == []


def test_black_edge_choice(spark, rows):
    schema = "id string, con string, node_id string, seq string, oval_size int, cov float"
    tail = "ACGTACGTACGTACGTACGTACGT"
    src = [
        ("agree", "ff", "x", "GG" + tail, 2, 1.0), ("agree", "ff", "y", "GG" + tail, 2, 3.0), ("agree", "rf", "z", "T" * 90, 0, 9.0),
        ("differ", "ff", "x", "GG" + tail, 2, 1.0), ("differ", "ff", "y", "GG" + "T" * 24, 2, 1.0),
        ("three of five", "ff", "x", tail, 0, 3.0), ("three of five", "ff", "y", "T" * 24, 0, 2.0),
        ("single", "ff", "x", tail, 0, 1.0), ("behind", "ff", "x", "ACG", 0, 1.0), ("behind", "rr", "y", tail, 0, 1.0), ("other", "rr", "x", tail, 0, 1.0),
    ]
    got = {r[0]: r[2] for r in rows(c.select_black_edge(spark.createDataFrame(src, schema), "f"))}
    assert got == {"agree": "y", "differ": None, "three of five": "x", "single": "x", "behind": None, "other": None}


def test_node_lines(spark):
    df = spark.createDataFrame(
        [("n1", "ACTG", "A", 2.125, {"ff": ["b!3", "c!4"], "er": ["d!5"]}, True, "f", ["m_1", "m_2"]), ("n2", "AC", "GT", 1.0, None, False, None, [])],
        "id string, seq_f string, seq_r string, cov double, edges map<string,array<string>>, is_unique boolean, merge_dir string, mates array<string>",
    )
    lines = node_lines(df)
    got = {r["id"]: r["line"] for r in lines.collect()}
    assert got["n1"].split("\t") == ["n1", "N", "*s", "CS!A", "*v", "2.12", "*ff", "b!3", "c!4", "*er", "d!5", "*u", "1", "*m", "f", "*f", "m_1", "m_2"]
    assert got["n2"].split("\t") == ["n2", "N", "*s", "C!O", "*v", "1.00"]
    back = {r["id"]: r["fields"] for r in parse_node_lines(lines).collect()}
    assert back["n1"] == {"s": ["CS!A"], "v": ["2.12"], "ff": ["b!3", "c!4"], "er": ["d!5"], "u": ["1"], "m": ["f"], "f": ["m_1", "m_2"]}
    again = spark.createDataFrame([("x\tN\t*ff\ta!1\t*rr\t*ff\tb!2",), ("y\tQ\t*v\t1",)], "line string")
    only = parse_node_lines(again, only=["ff", "v"]).collect()
    assert only[0]["fields"] == {"ff": ["a!1", "b!2"]} and only[1]["fields"] == {"v": ["1"]}
    assert parse_node_lines(again.where(again.line.startswith("x"))).first()["fields"] == {"ff": ["a!1", "b!2"], "rr": []}
    with pytest.raises(Exception, match="unknown code"):
        parse_node_lines(again).collect()
    with pytest.raises(Exception, match="cannot be written"):
        node_lines(df.withColumn("mertag", F.lit("*x"))).collect()


def test_node_lines_without_reads_or_coverage(spark, tmp_path):
    from strandloom.plans.queries import queries

    nodes = [("a", "ACTG", None, 1.0), ("b", None, "A", 1.0), ("c", None, None, 1.0), ("d", "ACNG", "A", None), ("e", None, None, None), ("e", None, None, None)]
    spark.createDataFrame(nodes, "id string, read_f string, read_r string, cov float").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([("e", "ff", "a", 3)], SCHEMA).write.parquet(f"{tmp_path}/edges.parquet")
    got = sorted(r["line"].split("\t") for r in queries()["node_message_all"](spark, str(tmp_path)).collect())
    assert got == [["a", "N", "*s", "CS!", "*v", "1.00"], ["b", "N", "*s", "!A", "*v", "1.00"], ["c", "N", "*v", "1.00"], ["d", "N", "*s", "null!A"], ["e", "N", "*ff", "a!3"]]
    assert {tuple(r) for r in queries()["node_parse_all"](spark, str(tmp_path)).collect()} == {
        ("a", "CS!", "1.00", 0), ("b", "!A", "1.00", 0), ("c", None, "1.00", 0), ("d", "null!A", None, 0), ("e", None, None, 1)
    }


def test_fields_of_nodes(spark):
    from strandloom.functions import fields as f

    df = spark.createDataFrame([({"a": ["1", "2"], "u": ["1"], "e": []}, "x"), (None, "y")], "m map<string,array<string>>, v string")

    def both(c):
        return [r[0] for r in df.select(c).collect()]

    assert both(f.has("m", "a")) == [True, False] and both(f.get("m", "a")) == [["1", "2"], None] and both(f.first("m", "e")) == [None, None]
    assert both(f.clear("m", "a")) == [{"u": ["1"], "e": []}, {}]
    assert both(f.get(f.put("m", "a", F.array("v", "v")), "a")) == [["x", "x"], ["y", "y"]]
    assert both(f.has(f.put("m", "a", F.lit(None).cast("array<string>")), "a")) == both(f.has(f.put("m", "a", F.array().cast("array<string>")), "a")) == [False, False]
    assert both(f.get(f.put_one("m", "a", F.col("v")), "a")) == [["x"], ["y"]] and both(f.has(f.put_one("m", "a", F.lit(None).cast("string")), "a")) == [False, False]
    assert both(f.get(f.append("m", "a", F.col("v")), "a")) == [["1", "2", "x"], ["y"]] and both(f.get(f.append("m", "a", F.lit(None).cast("string")), "a")) == [["1", "2"], None]
    assert both(f.get(f.append_once("m", "a", F.lit("2")), "a")) == [["1", "2"], ["2"]]
    assert both(f.flag("m", "u")) == [True, False] and both(f.flag(f.set_flag("m", "u", F.col("v") == "y"), "u")) == [False, True]
    assert both(f.note("v", F.lit(2.0).cast("float"), F.lit(3))) == ["x|2.0|3", "y|2.0|3"] and both(f.note("v", F.lit(None))) == [None, None]
    assert [tuple(r) for r in both(f.note_parts(F.lit("a||c"), "p", "q", "r", "s"))] == [("a", "", "c", None)] * 2


def test_node_files(spark, tmp_path):
    from strandloom.sources.nodemsg import read_node_lines, write_node_lines

    lines = spark.createDataFrame([("n1", "n1\tN\t*s\tC!A\t*ff\ta!1\tb!2"), ("n2", "n2\tN"), ("", "")], "id string, line string")
    for packed in (None, "gzip"):
        write_node_lines(lines, str(tmp_path / "n"), packed)
        assert sorted((r["id"], r["fields"]) for r in read_node_lines(spark, str(tmp_path / "n")).collect()) == [("n1", {"s": ["C!A"], "ff": ["a!1", "b!2"]}), ("n2", {})]
    assert [r["fields"] for r in read_node_lines(spark, str(tmp_path / "n"), ["ff"]).where("id = 'n1'").collect()] == [{"ff": ["a!1", "b!2"]}]


def test_hubs_are_cut_in_parts(spark, rows):
    """Consensus and choice of a group of many items equal those of its first items and sums."""
    import random

    rng = random.Random(1)
    items = [("hub", "".join(rng.choices("ACGT", k=rng.randrange(5, 9))), float(rng.randrange(1, 4))) for _ in range(700)] + [("one", "AC", 1.0), ("two", "ACG", 1.0), ("two", "AC", 5.0)]
    ranked = sorted((s for g, s, _ in items if g == "hub"), key=lambda s: (-len(s), s))
    at = len(ranked[1])
    sums = [{b: sum(int(w) for g, s, w in items if g == "hub" and len(s) > i and s[i] == b) for b in "ATCG"} for i in range(at)]
    want = "".join(next((b for b in "ATCG" if all(x[b] > x[o] for o in "ATCG" if o != b)), "N") for x in sums)
    got = dict(cons(spark, rows, c.consensus_plurality, items, (1, 1)))
    assert got == {"hub": want, "one": "AC", "two": "AC"}


def test_long_lists_come_in_parts(spark, rows):
    src = [("hub", "ff", f"n{i:03}", i % 40 - 20) for i in range(300)] + [("a", "ff", "b", -1), ("a", "rr", "b", 5)]
    lists = e.merged_lists(spark.createDataFrame(src, SCHEMA), 20)
    hub = [r["links"] for r in lists.where("src = 'hub'").collect()]
    assert len(hub) > 10 and max(map(len, hub)) < 60 and sorted(x for p in hub for x in p) == sorted(f"{d}!{n}" for s, _, d, n in src if s == "hub")
    assert rows(lists.where("src = 'a'")) == [("a", "ff", 0, ["b!-1"]), ("a", "rr", 0, ["b!5"])]
    inside = rows(e.contained_reads(spark.createDataFrame(src, SCHEMA), 20))
    assert sorted(x for i, c in inside if i == "hub" for x in c) == sorted(d for s, _, d, n in src if s == "hub" and n < 0) and ("a", ["b"]) in inside
