import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandloom.sources.structural import _index, load_blocks, loaded, rejected

SCHEMA = "block_no long, form string, fields_txt string, tag string"
GOOD = "@a:1/1\nACGT\n+\nFFFF\n@a:1/2\nNACG\n+x\n#,\"F\n"


def model(form, text, tag):
    """Reason and values of a block, record by record."""
    if text is None or not text.strip(" \t\r\n"):
        return "empty", None
    if form == "lines":
        lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
        while lines and not lines[-1]:
            lines.pop()
        if len(lines) != 8:
            return "arity", None
        if lines[0][:1] != "@" or lines[4][:1] != "@":
            return "header", None
        if lines[2][:1] != "+" or lines[6][:1] != "+":
            return "separator", None
        if lines[0][-2:] != "/1" or lines[4][-2:] != "/2" or lines[0][:-2] != lines[4][:-2]:
            return "mate", None
        v = [lines[i] for i in (0, 1, 3, 5, 7)]
    elif form == "csv":
        record, v, i = text.rstrip("\r\n"), [], 0
        while True:
            if record[i : i + 1] == '"':
                m = re.compile(r'"((?:[^"]|"")*)"').match(record, i)
                if not m:
                    return "quoting", None
                v.append(m[1].replace('""', '"'))
            else:
                m = re.compile(r'[^",\r\n]*').match(record, i)
                v.append(m[0])
            i = m.end()
            if i == len(record):
                break
            if record[i] != ",":
                return "quoting", None
            i += 1
        if len(v) != 5:
            return "arity", None
    else:
        return "form", None
    if not all(re.fullmatch("[ACGTNacgtn]+", v[i]) for i in (1, 3)):
        return "bases", None
    if not all(re.fullmatch("[!-~]+", v[i]) for i in (2, 4)):
        return "quality", None
    name = re.sub("[ :#-]", "_", v[0]).replace("@", "").replace("/1", "")
    if not name or name != tag:
        return "tag", None
    return None, [name, *v[1:]]


def check(got, form, text, tag):
    reason, v = model(form, text, tag)
    assert got[0] == reason, (form, text, tag)
    assert list(got[1:]) == (v or [None] * 5)


CASES = [
    ("lines", None, "x"), ("lines", "", "x"), ("csv", " \t\r\n", "x"), (None, GOOD, "a_1"), ("xml", GOOD, "a_1"),
    ("lines", GOOD, "a_1"), ("lines", GOOD, None), ("lines", GOOD, "b"), ("lines", GOOD.replace("\n", "\r\n") + "\r\n\n", "a_1"),
    ("lines", GOOD + "x", "a_1"), ("lines", GOOD.replace("@a:1/2", "a:1/2"), "a_1"), ("lines", GOOD.replace("+x", ""), "a_1"),
    ("lines", GOOD.replace("/2", "/1"), "a_1"), ("lines", GOOD.replace("ACGT", "ACXT"), "a_1"), ("lines", GOOD.replace("FFFF", "FéF"), "a_1"),
    ("lines", "@/1\nA\n+\n!\n@/2\nC\n+\n~", ""), ("lines", "\n" * 7 + "x", "x"),
    ("csv", "@a/1,A,F,C,F", "a"), ("csv", '"@a/1","A","""",C,"F,F"\r\n', "a"), ("csv", '"@a/1,A,F,C,F', "a"), ("csv", '@a"/1,A,F,C,F', "a"),
    ("csv", '"@a/1"x,A,F,C,F', "a"), ("csv", "@a/1,A,F,C", "a"), ("csv", "@a/1,A,F,C,", "a"), ("csv", "@a/1,A\n,F,C,F", "a"), ("csv", '"","","","",""', ""),
    ("csv", '"""",A,F,C,F', '"'), ("csv", ",,,,", "x"), ("csv", "@ü/1,A,F,C,F", "ü"), ("csv", '@a/1,A,F,C,""', "a"), ("csv", '"a\nb",A,F,C,F', "a\nb"),
]


def test_each_kind_of_fault(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], SCHEMA)
    got = {r["block_no"]: tuple(r)[1:] for r in load_blocks(df.withColumn("reason", df.form)).collect()}
    assert len(got) == len(CASES)
    for i, c in enumerate(CASES):
        check(got[i], *c)
    assert {r["block_no"] for r in rejected(df).collect()} | {r["block_no"] for r in loaded(df).collect()} == set(got)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["lines", "csv", None]), st.one_of(st.none(), st.text('@a/12AC+F",\r\n é', max_size=40)), st.one_of(st.none(), st.text("a2_", max_size=3))), min_size=1, max_size=12))
def test_any_text(blocks):
    import pyarrow as pa

    t = pa.table({"block_no": range(len(blocks)), "form": pa.array([b[0] for b in blocks], pa.string()), "fields_txt": pa.array([b[1] for b in blocks], pa.string()), "tag": pa.array([b[2] for b in blocks], pa.string())})
    for got, block in zip(_index(t).to_pylist(), blocks):
        check(tuple(got.values())[1:], *block)


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/raw_blocks.parquet")
    got = {r["block_no"]: tuple(r)[1:] for r in load_blocks(df).collect()}
    for r in df.collect():
        check(got[r["block_no"]], r["form"], r["fields_txt"], r["tag"])


def test_empty_table_repeated_and_long_blocks(spark):
    assert load_blocks(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "@a/1," + "A" * 3_000_000 + ",F,C," + "~" * 3_000_000
    df = spark.createDataFrame([(1, "csv", long, "a"), (1, "csv", long, "a")], SCHEMA)
    got = loaded(df).collect()
    assert [len(r["seq_f"]) for r in got] == [3_000_000] * 2
