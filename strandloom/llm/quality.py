"""Statistics of text quality and fixed-threshold rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import write_table

SPACE = " \t\r\n"
#: The printable ASCII characters other than letters, digits and space (fixed values).
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters that end a sentence (fixed values).
ENDERS = [".", "!", "?", ";", ":", "…", "。", "！", "？"]
#: Common words that stand in the plan; of a longer list the words of the texts are joined with it.
MOST_IN_PLAN = 10_000
#: Two of these at least stand in prose (fixed values).
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
BULLETS = ("•", "-", "*", "‣", "◦")


def _bare(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(SYMBOLS))


def _parts(documents: DataFrame, key: str, text: str) -> DataFrame:
    t = documents.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).where("text is not null")
    return t.select(
        "_key", "text",
        F.filter(F.split("text", "[ \t\r\n]+"), lambda w: w != "").alias("words"),
        F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: x != "").alias("lines"),
    )


def text_counts(documents: DataFrame, common: DataFrame | None, key: str = "doc_id", text: str = "text", most: int = MOST_IN_PLAN) -> DataFrame:
    """What is counted in each text that is not null: ``(_key, size, words, letters, symbols, marks,
    alphabetic, stops, common, lines, enders, bullets, trailing)``. A statistic that is not used costs nothing.

    All expressions run in the JVM on one pass over the texts. A list of common words
    beyond ``most`` entries is joined with the words instead of standing in the plan; the texts are
    numbered and written for that, so repeated keys stay apart. Without a list ``common`` is 0.
    """
    p = _parts(documents, key, text)
    n_common = F.lit(0)
    if common is not None:
        listed = common.select(F.col("word").cast("string").alias("word")).where("word is not null and word != ''").distinct()
        few = listed.limit(most + 1).collect()
        if len(few) <= most:
            known = [r["word"] for r in few] or [""]
            n_common = F.size(F.filter(F.transform("words", _bare), lambda w: w.isin(known) & (w != "")))
        else:
            p, _ = write_table(p.withColumn("_row", F.monotonically_increasing_id()), "texts")
            each = p.select("_row", F.explode("words").alias("w")).select("_row", _bare(F.col("w")).alias("word"))
            hits = each.groupBy("_row", "word").agg(F.count("*").alias("n")).join(listed, "word", "left_semi")
            p = p.join(hits.groupBy("_row").agg(F.sum("n").alias("_common")), "_row", "left")
            n_common = F.coalesce("_common", F.lit(0))
    n_lines = lambda test: F.size(F.filter("lines", test))
    return p.select(
        "_key", F.length("text").alias("size"), F.size("words").alias("words"), F.length(F.translate("text", SPACE, "")).alias("letters"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("symbols"),
        (F.size(F.split("text", r"#|\.\.\.|…")) - 1).alias("marks"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).alias("alphabetic"),
        F.size(F.array_intersect(F.transform("words", _bare), F.array(*map(F.lit, STOP_WORDS)))).alias("stops"),
        n_common.alias("common"), F.size("lines").alias("lines"),
        n_lines(lambda x: F.substring(x, -1, 1).isin(ENDERS)).alias("enders"), n_lines(lambda x: F.substring(x, 1, 1).isin(*BULLETS)).alias("bullets"),
        n_lines(lambda x: x.endswith("...") | x.endswith("…")).alias("trailing"),
    )


def _share(a: str, b: str) -> Column:
    """Thousandths, rounded down; 0 where there is nothing to divide by."""
    return F.when(F.col(b) == 0, F.lit(0)).otherwise(F.call_function("div", F.col(a).cast("long") * 1000, F.col(b))).cast("long")


def _reasons() -> Column:
    """The names of the rules that a text breaks, in a fixed order."""
    c = F.col
    rules = [
        ("words", ~c("words").between(50, 100_000)), ("word_length", (c("letters") < c("words") * 3) | (c("letters") > c("words") * 10)),
        ("symbols", c("marks") * 10 > c("words")), ("bullets", c("bullets") * 10 > c("lines") * 9), ("ellipses", c("trailing") * 10 > c("lines") * 3),
        ("alphabetic", c("alphabetic") * 10 < c("words") * 8), ("stop_words", c("stops") < 2),
    ]
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)))


def text_quality(documents: DataFrame, common: DataFrame | None, key: str = "doc_id", text: str = "text", most: int = MOST_IN_PLAN) -> DataFrame:
    """``(key, n_words, mean_len_m, symbols_m, enders_m, common_m, bullets_m, reasons)`` for each row with
    a text: its statistics, shares and the mean length in thousandths, rounded down, 0 where there
    is nothing to divide by, and the published document rules that it breaks by them. Empty texts have zeros; repeated keys
    give a row each.

    The rules: words (50 to 100,000), word_length (mean 3 to 10), symbols (# and
    ellipses at most 0.1 a word), bullets (at most 0.9 of the lines), ellipses (at
    most 0.3 of the lines end so), alphabetic (at least 0.8 of the words have a
    letter), stop_words (two different ones at least).
    """
    return text_counts(documents, common, key, text, most).select(
        F.col("_key").alias(key), F.col("words").cast("long").alias("n_words"), _share("letters", "words").alias("mean_len_m"),
        _share("symbols", "size").alias("symbols_m"), _share("enders", "lines").alias("enders_m"), _share("common", "words").alias("common_m"),
        _share("bullets", "lines").alias("bullets_m"), _reasons().alias("reasons"),
    )


def text_stats(documents: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_IN_PLAN) -> DataFrame:
    """The five statistics of ``text_quality`` that problem 10 asks for."""
    return text_quality(documents, common, key, text, most).select(key, "n_words", "mean_len_m", "symbols_m", "enders_m", "common_m")


def failed_rules(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, reasons)`` of ``text_quality``, which need no list of common words."""
    return text_quality(documents, None, key, text).select(key, "reasons")
