import re

from pyspark.sql import functions as F

from strandloom.llm.quality import SYMBOLS, failed_rules, text_quality, text_stats

TEXTS = [
    None, "", " \t\r\n", "The cat, the hat.", "«And» (THE) end…\n\n- item\n- item two!", "a", "...", "日本語。\r\n全角！\nx", "the cat sat", "!!! ?? the!!!the 'the'",
    "line. \t\r\nline\r\n. x", "The " * 5000, "x" * 100_000, "😀 and 😀.", "#the# ~and~ [of]",
]
COMMON = ["the", "and", "of", "the", None, "über"]


def model(text, common):
    w = re.findall("[^ \t\r\n]+", text)
    lines = [x for x in (y.strip(" \t\r\n") for y in text.split("\n")) if x]
    per = lambda a, b: 1000 * a // b if b else 0
    return (
        len(w), per(sum(map(len, w)), len(w)), per(sum(c in SYMBOLS for c in text), len(text)),
        per(sum(x[-1] in ".!?;:…。！？" for x in lines), len(lines)), per(sum(x.lower().strip(SYMBOLS) in common for x in w), len(w)),
    )


def test_stats(spark, rows):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string").withColumn("words", F.lit("x")).withColumn("_row", F.lit(1))
    common = spark.createDataFrame([(x,) for x in COMMON], "word string")
    want = sorted([(i, *model(t, set(COMMON))) for i, t in [*enumerate(TEXTS), (3, TEXTS[3])] if t is not None], key=repr)
    assert rows(text_stats(df, common)) == want
    assert rows(text_stats(df, common, most=1)) == want  # a list too long for the plan is joined
    none = [(*r[:5], 0) for r in want]
    assert rows(text_stats(df, common.limit(0))) == sorted(none, key=repr)
    assert text_stats(df.limit(0), common).collect() == []


def test_rules(spark):
    prose = "The quick brown fox and the lazy dog have been to the river. " * 8
    texts = [prose, "the of", "\n".join(["- the and of to be have that with wordless " + str(i) for i in range(20)]), prose + "# " * 40, "x1 " * 60, "12 " * 60 + "the and", (prose[:60] + "...\n") * 9, "supercalifragilistic and the " * 30, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["reasons"] for r in failed_rules(df).collect()}
    assert got[0] == [] and got[1] == ["words", "word_length"] and got[2] == ["bullets"] and "symbols" in got[3]
    assert got[4] == ["word_length", "stop_words"] and got[5] == ["word_length", "alphabetic"] and "ellipses" in got[6] and got[7] == [] and 8 not in got


def test_one_operator_gives_statistics_and_rules(spark):
    df = spark.createDataFrame([(1, "- a b\n* the and\nwords."), (2, None)], "doc_id long, text string")
    common = spark.createDataFrame([("the",), ("b",)], "word string")
    for most in (10, 1):
        assert [tuple(r) for r in text_quality(df, common, most=most).collect()] == [(1, 7, 2285, 136, 333, 285, 666, ["words", "word_length", "alphabetic"])]
