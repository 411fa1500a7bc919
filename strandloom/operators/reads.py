"""Cleaning of raw read pairs: arity, ids, case, N at the ends, length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.dna import clean_id, trim_n
from strandloom.sources import structural

K = 21
#: Coverage that a pair starts with.
FIRST_COV = 2.0


def split_block(text: Column | str) -> Column:
    """Lines of a block without a CR at their end; empty ones at the end are dropped."""
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(F.regexp_replace(c, "[\r\n]+$", ""), "\n"), lambda x: F.regexp_replace(x, "\r$", ""))


def judged(blocks: DataFrame, text: str = "fields_txt", k: int = K, trim_mode: str = "keep", keep: tuple[str, ...] = (), odd: str = "keep") -> DataFrame:
    """All blocks, the columns ``keep`` of them, with their cleaned id and mates and ``verdict``: input_lines_invalid
    (not eight lines), very_reads_short (a trimmed mate of k letters or fewer),
    with ``odd`` "drop" reads_non_dna (a letter other than A, C, G, T inside a mate), or reads_good."""
    lines = blocks.select(*keep, split_block(F.coalesce(text, F.lit(""))).alias("_l"))
    line = lambda i: F.get(F.col("_l"), F.lit(i))
    r = lines.select(
        *keep, (F.size("_l") == 8).alias("_eight"), clean_id(line(0)).alias("id"),
        trim_n(F.upper(line(1)), trim_mode).alias("seq_f"), trim_n(F.upper(line(5)), trim_mode).alias("seq_r"),
    )
    dna_f, dna_r = (F.col(c).rlike("[^ACGT]") for c in ("seq_f", "seq_r"))
    verdict = (
        F.when(~F.col("_eight"), "input_lines_invalid")
        .when(F.least(F.length("seq_f"), F.length("seq_r")) <= k, "very_reads_short")
        .when((dna_f | dna_r) & F.lit(odd == "drop"), "reads_non_dna")
        .otherwise("reads_good")
    )
    return r.select(
        *keep, "id", "seq_f", "seq_r", verdict.alias("verdict"),
        (F.col("_eight") & dna_f).alias("odd_f"), (F.col("_eight") & dna_r).alias("odd_r"),
    )


def prepare_reads(blocks: DataFrame, text: str = "fields_txt", k: int = K, trim_mode: str = "keep", odd: str = "keep") -> DataFrame:
    """``(id, seq_f, seq_r, cov)`` of the good pairs. One pass, no shuffle; blank and
    null blocks are invalid; repeated pairs stay."""
    good = judged(blocks, text, k, trim_mode, odd=odd).where("verdict = 'reads_good'")
    return good.select("id", "seq_f", "seq_r", F.lit(FIRST_COV).cast("float").alias("cov"))


def read_metrics(blocks: DataFrame, text: str = "fields_txt", k: int = K) -> DataFrame:
    """``(counter, n)``: the stage's counters as rows."""
    j = judged(blocks, text, k)
    when = lambda c: F.count_if(c)
    names = ["input_lines_invalid", "f_reads_with_non_dna_characters", "r_reads_with_non_dna_characters", "very_reads_short", "reads_good"]
    one = j.agg(
        when(F.col("verdict") == names[0]).alias(names[0]), when(F.col("odd_f")).alias(names[1]), when(F.col("odd_r")).alias(names[2]),
        when(F.col("verdict") == names[3]).alias(names[3]), when(F.col("verdict") == names[4]).alias(names[4]),
    )
    return one.unpivot([], names, "counter", "n")


def judged_deliveries(blocks: DataFrame, k: int = K, trim_mode: str = "keep", odd: str = "keep") -> DataFrame:
    """``(block_no, id, seq_f, seq_r, verdict, odd_f, odd_r)`` of all blocks ``(block_no, form,
    fields_txt, tag)`` of both forms: eight lines, or the five values of a csv record, go
    through the same cleaning. Marks, qualities and tags are not looked at, as in the
    reference's own rule for lines. ``verdict`` is the reason of ``load_blocks`` for blocks
    without such values, else as in ``judged``."""
    t = structural.load_blocks(blocks, shape_only=True)
    r = t.select("block_no", "reason", F.col("name").alias("id"), *(trim_n(F.upper(c), trim_mode).alias(c) for c in ("seq_f", "seq_r")))
    dna_f, dna_r = (F.coalesce(F.col(c).rlike("[^ACGT]"), F.lit(False)) for c in ("seq_f", "seq_r"))
    verdict = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.least(F.length("seq_f"), F.length("seq_r")) <= k, "very_reads_short")
        .when((dna_f | dna_r) & F.lit(odd == "drop"), "reads_non_dna")
        .otherwise("reads_good")
    )
    return r.select("block_no", "id", "seq_f", "seq_r", verdict.alias("verdict"), dna_f.alias("odd_f"), dna_r.alias("odd_r"))


def prepare_deliveries(blocks: DataFrame, k: int = K, trim_mode: str = "keep", odd: str = "keep") -> DataFrame:
    """``prepare_reads`` over blocks of both forms."""
    good = judged_deliveries(blocks, k, trim_mode, odd).where("verdict = 'reads_good'")
    return good.select("id", "seq_f", "seq_r", F.lit(FIRST_COV).cast("float").alias("cov"))


def delivery_metrics(blocks: DataFrame, k: int = K, odd: str = "keep") -> DataFrame:
    """``(counter, n)``: how many blocks got each verdict, and the mates with odd letters."""
    j = judged_deliveries(blocks, k, odd=odd)
    mates = F.array(*(F.when(F.col(f"odd_{m}"), f"{m}_reads_with_non_dna_characters") for m in "fr"))
    counters = j.select(F.explode(F.array_compact(F.concat(F.array("verdict"), mates))).alias("counter"))
    return counters.groupBy("counter").agg(F.count("*").alias("n"))


def first_value(text: str = "fields_txt", form: str = "form") -> Column:
    """The header of a block: its first line, or the first value of a csv record; null
    where that value is not closed."""
    c = F.coalesce(text, F.lit(""))
    head = F.regexp_extract(F.regexp_replace(c, "[\r\n]+$", ""), r'^("[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)(?:,|\z)', 1)
    closed = F.regexp_replace(c, "[\r\n]+$", "").rlike(r'^("[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)(?:,|\z)')
    bare = F.when(head.startswith('"'), F.replace(F.substring(head, F.lit(2), F.length(head) - 2), F.lit('""'), F.lit('"'))).otherwise(head)
    return F.when(F.col(form) == "csv", F.when(closed, bare)).otherwise(F.get(split_block(c), F.lit(0)))


def usable_nodes(nodes: DataFrame, k: int = K, odd: str = "keep") -> DataFrame:
    """``(id, seq_f, seq_r, cov)`` of the nodes whose two reads are longer
    than k: what the overlap stages take in. Reads with a letter other than A, C, G, T
    stay (the k-mers that hold one are left out later); ``odd`` "drop" leaves
    out the whole pair. Exact copies are dropped; an id with several contents has a row for
    each. Nodes with reads in a column ``contained`` are left out, where there is one."""
    if "contained" in nodes.columns:
        nodes = nodes.where(F.col("contained").isNull())
    ok = nodes.where(F.col("id").isNotNull() & (F.length("read_f") > k) & (F.length("read_r") > k))
    if odd == "drop":
        ok = ok.where(~F.col("read_f").rlike("[^ACGT]") & ~F.col("read_r").rlike("[^ACGT]"))
    return ok.groupBy("id", F.col("read_f").alias("seq_f"), F.col("read_r").alias("seq_r")).agg(F.min("cov").alias("cov"))
