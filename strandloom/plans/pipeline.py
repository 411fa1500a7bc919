"""The whole pipeline and its command line: FASTQ in, cleaned reads, edges and digraph out."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.dna import clean_id, trim_n
from strandloom.operators import overlap, reads
from strandloom.sources.fastq import read_fastq


def clean_pairs(pairs: DataFrame, k: int = reads.K, trim_mode: str = "keep", odd: str = "keep") -> DataFrame:
    """``(id, seq_f, seq_r, cov)`` of pairs as the FASTQ source reads them; short pairs
    are left out, and with ``odd`` "drop" those with a letter other than A, C, G, T inside."""
    r = pairs.select(clean_id("id").alias("id"), trim_n(F.upper("seq_f"), trim_mode).alias("seq_f"), trim_n(F.upper("seq_r"), trim_mode).alias("seq_r"))
    ok = r.where((F.length("seq_f") > k) & (F.length("seq_r") > k))
    if odd == "drop":
        ok = ok.where(~F.col("seq_f").rlike("[^ACGT]") & ~F.col("seq_r").rlike("[^ACGT]"))
    return ok.withColumn("cov", F.lit(reads.FIRST_COV).cast("float"))


def assemble_graph(pairs: DataFrame, k: int = reads.K, mode: str = "canonical", max_kmer_freq: int | None = None, odd: str = "keep") -> dict[str, DataFrame]:
    """The stages' results by name: reads, edges, digraph. Rows of one id are one node,
    which has the edges of all of them; only exact copies are dropped."""
    own = clean_pairs(pairs, k, odd=odd).distinct()
    edges = overlap.match_prefix(own, k, mode, max_kmer_freq)
    if mode == "full":
        edges = overlap.remove_mirrors(edges)
    return {"reads": own, "edges": edges, "digraph": overlap.to_digraph(edges)}


def write_rows(df: DataFrame, path: str, form: str = "parquet", compression: str | None = None) -> None:
    """A stage's rows as Parquet or as tab-separated text, over what lay there."""
    w = df.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.parquet(path) if form == "parquet" else w.option("sep", "\t").csv(path)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandloom", description="Overlap graph of interleaved paired FASTQ files.")
    p.add_argument("-i", "--input", required=True, help="file or folder of FASTQ")
    p.add_argument("-o", "--output", required=True, help="folder for reads, edges and digraph")
    p.add_argument("-k", type=int, default=reads.K, help="length of k-mers")
    p.add_argument("--odd", choices=("keep", "drop"), default="keep", help="pairs with a letter other than A, C, G, T inside: keep them and leave out only their k-mers with one, or drop them")
    p.add_argument("--format", choices=("parquet", "tsv"), default="parquet")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    for name, df in assemble_graph(read_fastq(spark, a.input), a.k, odd=a.odd).items():
        seen = Observation(name)
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        write_rows(counted, f"{a.output}/{name}", a.format)
        print(f"{name}: {seen.get['rows']} rows")


if __name__ == "__main__":
    main()
