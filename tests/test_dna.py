import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna


@pytest.fixture(scope="module")
def value(spark):
    def run(column, **values):
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
        return df.select(column.alias("out")).first()["out"]

    return run


@pytest.mark.parametrize("s, out", [("ACGTNN", "ACGT"), ("NNACGTACGT", "ACGTAC"), ("NNNACG", "NNNACG"), ("NNN", ""), ("", ""), ("NACG", "AC"), (None, None)])
def test_trim(value, s, out):
    assert value(dna.trim_n("s"), s=s) == out


def test_trim_clean(value):
    assert value(dna.trim_n("s", "clean"), s="NNNACGNN") == "ACG"


@pytest.mark.parametrize("s, out", [("ACGTN", "ACGT"), ("AACG", "CGTT"), ("", ""), ("xyz", "")])
def test_revcomp(value, s, out):
    assert value(dna.revcomp("s"), s=s) == out


@pytest.mark.parametrize("s, out", [("ACTG", "CS"), ("A", "A"), ("ACG", "CK"), ("", ""), ("ACGTN", "COnull"), ("TTTT", "TT")])
def test_encode(value, s, out):
    assert value(dna.encode_dna("s"), s=s) == out


def test_code_is_a_round_trip(spark):
    rng = random.Random(1)
    src = ["".join(rng.choices("ACGT", k=n)) for n in range(60)]
    df = spark.createDataFrame([(s,) for s in src], "s string").select("s", dna.decode_dna(dna.encode_dna("s")).alias("t"), dna.encode_dna("s").alias("e"))
    got = df.collect()
    assert all(r["s"] == r["t"] for r in got) and len({r["e"] for r in got}) == 60


def test_decode_unknown(value):
    assert value(dna.decode_dna("s"), s="AZ") == "Anull"


@pytest.mark.parametrize("s, out", [("@a:b-c#d e/1", "a_b_c_d_e"), ("@x/12/1", "x2"), ("@/@1", "")])
def test_clean_id(value, s, out):
    assert value(dna.clean_id("s"), s=s) == out


@pytest.mark.parametrize("s, out", [("r_1", "r_2"), ("r_2", "r_1"), ("r", None), ("", None)])
def test_mate_name(value, s, out):
    assert value(dna.mate_name("s"), s=s) == out


def test_flips(value):
    assert [value(dna.flip_dir("s"), s=x) for x in "fr"] == ["r", "f"]
    assert [value(dna.flip_link("s"), s=x) for x in ("ff", "fr", "fe", "re", "rr", "rf")] == ["rr", "rf", "re", "fe", "ff", "fr"]
    for c, s in ((dna.flip_dir("s"), "e"), (dna.flip_link("s"), "ef"), (dna.checked_type("s"), "fx")):
        with pytest.raises(Exception, match="unknown"):
            value(c, s=s)


def test_distance(value):
    assert value(dna.edit_distance("a", "b"), a="kitten", b="sitting") == 3
    with pytest.raises(Exception, match="null"):
        value(dna.edit_distance("a", "b"), a="x", b=None)


def near(a, b):
    """The rule, step by step."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if n > 1000:
        w = n // 100
        return sum(a[w * i : w * i + w] == b[w * i : w * i + w] for i in range(100)) + (a[w * 99 :] == b[w * 99 :]) >= 90
    d = list(range(n + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[n] * 10 < n


def test_fast_compare(spark):
    rng = random.Random(2)
    src = [("", ""), ("A" * 20, "A" * 18 + "CC"), ("A" * 20, "A" * 19 + "C")]
    for n, edits in ((30, 2), (30, 3), (1500, 5), (1500, 9), (1500, 12), (1001, 11), (2345, 10)):
        a = "".join(rng.choices("ACGT", k=n))
        b = list(a)
        for i in rng.sample(range(n), edits):
            b[i] = "x"
        src.append((a, "".join(b) + "tail"))
    got = spark.createDataFrame(src, "a string, b string").select("a", "b", dna.fast_compare("a", "b").alias("y")).collect()
    assert [r["y"] for r in got] == [near(a, b) for a, b in src]


def test_concat_and_text(value):
    assert value(dna.str_concat("a", "b", 2), a="ACGT", b="GTAA") == "ACGTAA"
    with pytest.raises(Exception, match="shorter"):
        value(dna.str_concat("a", "b", 5), a="ACGT", b="GTAAA")
    assert [value(dna.two_places("x"), x=v) for v in (2.125, 2.375, 2.0)] == ["2.12", "2.38", "2.00"]
    assert value(dna.edge_text("a", "n"), a="x", n=22) == "x!22"


def test_lists(value):
    assert value(dna.count_pair_end("a", "b"), a=["x_1", "x_1", "y_1", "z"], b=["x_2"]) == 2
    assert value(dna.count_pair_end("a", "b"), a=None or ["x_1"], b=["x_1"]) == 0
    assert value(dna.ordered_distinct("a"), a=["b", "a", "b"]) == ["b", "a"]
    assert value(dna.pair_ends("a", "s"), a=["b"], s="own") == ["b"]


def test_texts_of_records(value):
    assert value(dna.tail_text("a", "d", "n"), a="x", d="f", n=3) == "x f 3"
    assert value(dna.candidate_text("a", "n", "c"), a="x", n=3, c=2.0) == "x!3|2.0"
    assert value(dna.overlap_text(dna.overlap_info("m", 1)), m="k\tO\tx\tACGT\tff\t22") == "ff x 22 ACGT"
    with pytest.raises(Exception, match="unknown"):
        value(dna.overlap_info("m"), m="k\tO\tx\tACGT\tff\t22")
