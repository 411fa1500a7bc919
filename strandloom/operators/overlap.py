"""K-mers of read pairs and the overlap join on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.dna import BASES, is_dna
from strandloom.operators.reads import K
from strandloom.operators.skew import spread


#: Parts of a k-mer that are cut to the cap by themselves.
CAP_PARTS = 64
#: The types of which mirrored edges keep one.
KEPT = ("ff", "fe", "rr", "re")


def _turned(seq: str) -> Column:
    """The whole read reverse complemented, letter by letter, so that each k-mer's own is a part of it."""
    return F.reverse(F.translate(F.col(seq), BASES, BASES[::-1]))


def _both(seq: Column, rc: Column, n: Column, at: Column, k: int) -> tuple[Column, Column]:
    """The k-mer that ``at`` of the n letters precede, and its reverse complement."""
    return F.substring(seq, at + 1, F.lit(k)), F.substring(rc, n - at - k + 1, F.lit(k))


def _clean(kmer: str) -> Column:
    """Whether a k-mer is all of A, C, G, T; looked at only where ``odd`` says that its read is not."""
    return ~F.col("odd") | is_dna(kmer)


def _item(kmer: Column, rc: Column, types: tuple[str, str], overlap: Column, once: bool) -> list[Column]:
    """The two forms in which a k-mer goes out: as it stands under the first type,
    reverse complemented under the second; or, once, its canonical form under the
    type that survives the removal of mirrored edges."""
    make = lambda w, t: F.struct(w.alias("kmer"), F.lit(t).alias("edge_type"), overlap.cast("int").alias("overlap"))
    if once:
        return [make(F.least(kmer, rc), types[0] if types[0] in KEPT else types[1])]
    return [make(kmer, types[0]), make(rc, types[1])]


def anchors(reads: DataFrame, k: int = K, once: bool = False) -> DataFrame:
    """The eight k-mers at the ends of each pair that overlaps start from; those with a
    letter other than A, C, G, T are left out, the pair's others stay."""
    items = []
    for seq, first, last in (("seq_f", ("ff", "fr"), ("ef", "fe")), ("seq_r", ("re", "er"), ("rf", "rr"))):
        n = F.length(seq)
        for at, types in ((F.lit(0), first), (n - k, last)):
            items += _item(*_both(F.col(seq), F.col(f"{seq}_rc"), n, at, k), types, n, once)
    turned = reads.select(
        "id", "cov", "seq_f", "seq_r", *(_turned(c).alias(f"{c}_rc") for c in ("seq_f", "seq_r")), (~is_dna("seq_f") | ~is_dna("seq_r")).alias("odd")
    )
    return turned.select("id", "cov", "odd", F.inline(F.array(*items))).where(_clean("kmer")).drop("odd").withColumn("is_anchor", F.lit(True))


def windows(reads: DataFrame, k: int = K, once: bool = False) -> DataFrame:
    """The k-mers between the ends, each mate within its own length. Overlaps count
    from the window to the end of mate 1, and from the start to the window's end in
    mate 2. Those with a letter other than A, C, G, T are left out. Mates and places are
    rows of their own, so all of it is generated code."""
    mate = lambda c: F.struct(F.lit(c == "seq_f").alias("fwd"), F.col(c).alias("s"), F.length(c).alias("n"), _turned(c).alias("rc"), (~is_dna(c)).alias("odd"))
    mates = reads.select("id", "cov", F.inline(F.array(mate("seq_f"), mate("seq_r")))).where(F.col("n") > k + 1)
    at = mates.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - k - 1)).alias("at"))
    one, rc = _both(*map(F.col, ("s", "rc", "n", "at")), k)
    overlap = F.when(F.col("fwd"), F.col("n") - F.col("at")).otherwise(F.col("at") + k).cast("int").alias("overlap")
    places = at.select("id", "cov", "fwd", "odd", one.alias("one"), rc.alias("turned"), overlap).where(_clean("one"))
    kind = lambda f, r: F.when(F.col("fwd"), f).otherwise(r).alias("edge_type")
    if once:
        out = places.select("id", "cov", F.least("one", "turned").alias("kmer"), kind("ff", "rr"), "overlap")
    else:
        forms = F.array(F.struct(F.col("one").alias("kmer"), kind("ff", "rf")), F.struct(F.col("turned").alias("kmer"), kind("fr", "rr")))
        out = places.select("id", "cov", F.inline(forms), "overlap").select("id", "cov", "kmer", "edge_type", "overlap")
    return out.withColumn("is_anchor", F.lit(False))


def kmers(reads: DataFrame, k: int = K) -> DataFrame:
    """``(id, cov, kmer, edge_type, overlap, is_anchor)``: anchors and windows."""
    return anchors(reads, k).unionByName(windows(reads, k))


def canonical_kmers(reads: DataFrame, k: int = K) -> DataFrame:
    """Half of the rows of ``kmers``: each place once, under the canonical k-mer, with
    the type that survives the removal of mirrored edges."""
    return anchors(reads, k, once=True).unionByName(windows(reads, k, once=True))


def kmer_counts(reads: DataFrame, k: int = K) -> DataFrame:
    """``(counter, n)``: places of k-mers, at the ends and inside, that are kept, and those
    left out for a letter other than A, C, G, T."""
    mates = reads.select(F.explode(F.array("seq_f", "seq_r")).alias("s")).select("s", (~is_dna("s")).alias("odd")).where(F.length("s") >= k)
    at = mates.select("odd", "s", F.explode(F.sequence(F.lit(0), F.length("s") - k)).alias("at")).select("odd", F.substring(F.col("s"), F.col("at") + 1, F.lit(k)).alias("kmer"))
    one = at.agg(F.count_if(_clean("kmer")).alias("kmers_kept"), F.count_if(~_clean("kmer")).alias("kmers_omitted"))
    return one.unpivot([], ["kmers_kept", "kmers_omitted"], "counter", "n")


def kmer_coverage(reads: DataFrame, k: int = K) -> DataFrame:
    """``(kmer, n, cov_sum)`` over the inner windows, coverage cut to whole numbers."""
    return windows(reads, k).groupBy("kmer").agg(F.count("*").alias("n"), F.sum(F.col("cov").cast("int")).alias("cov_sum"))


def cap_frequency(occurrences: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` occurrences a k-mer, the longest overlaps first, then by id. The first of each of
    ``CAP_PARTS`` parts of a k-mer are taken before the first of all, so a hot k-mer is not sorted in one task."""
    order = (F.desc("overlap"), "id", "edge_type", "is_anchor")
    part = spread(["id", "overlap", "edge_type"], CAP_PARTS).alias("_part")
    some = occurrences.select("*", part)
    for keys in (["kmer", "_part"], ["kmer"]):
        some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
    return some.drop("_part")


def match_prefix(reads: DataFrame, k: int = K, mode: str = "canonical", max_kmer_freq: int | None = None) -> DataFrame:
    """Distinct edges ``(src, edge_type, dst, overlap)``: each anchor meets all
    occurrences of its k-mer in other records.

    Mode ``canonical`` joins on canonical k-mers, with half of the rows on both
    sides, and needs no removal of mirrored edges; mode ``full`` keeps both
    strands. Rows of one id are one node: their edges are merged, and they have none
    between them. AQE splits hot k-mers, and
    ``max_kmer_freq`` caps them where that is wanted (off by default).
    """
    t = canonical_kmers(reads, k) if mode == "canonical" else kmers(reads, k)
    if max_kmer_freq:
        t = cap_frequency(t, max_kmer_freq)
    a = t.where("is_anchor").select("kmer", F.col("id").alias("src"), "edge_type")  # a constant of each part: windows aren't made for this side
    o = t.select("kmer", F.col("id").alias("dst"), "overlap")
    # four or eight rows a read, which the planner takes for one: never a side to broadcast on its estimate
    return a.join(o.hint("merge"), "kmer").where("src <> dst").select("src", "edge_type", "dst", "overlap").distinct()


def remove_mirrors(edges: DataFrame) -> DataFrame:
    """Edges without those of fr, rf, ef, er whose node has exactly the same list under
    ff, rr, fe, re. Lists are compared by counts per neighbour and overlap, so no
    list is ever gathered."""
    pairs = (("ff", "fr"), ("rr", "rf"), ("fe", "ef"), ("re", "er"))
    kind = F.col("edge_type")
    per = edges.groupBy("src", "dst", "overlap").agg(
        *(F.count_if(kind == t).alias(t) for pair in pairs for t in pair)
    )
    differ = per.groupBy("src").agg(*(F.max(F.col(a) != F.col(b)).alias(f"{b}_differs") for a, b in pairs))
    drop = None
    for _, b in pairs:
        this = (kind == b) & ~F.col(f"{b}_differs")
        drop = this if drop is None else drop | this
    return edges.join(differ, "src").where(~drop).select("src", "edge_type", "dst", "overlap")


def to_digraph(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` as a bag: edges of ff, fe, fr, ef as they stand, of rr, re, rf, er turned round."""
    turn = F.col("edge_type").isin("rr", "re", "rf", "er")
    return edges.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def degree(edges: DataFrame) -> DataFrame:
    """``(id, dir, degree)``: edges of the types dir+f and dir+r of each node; e types don't count."""
    plain = edges.where(F.col("edge_type").isin("ff", "fr", "rf", "rr"))
    return plain.groupBy(F.col("src").alias("id"), F.substring("edge_type", 1, 1).alias("dir")).agg(F.count("*").alias("degree"))


def digraph(nodes: DataFrame, k: int = K, odd: str = "keep") -> DataFrame:
    """From cleaned nodes to the digraph: one shuffle for the join, one for the distinct edges."""
    from strandloom.operators.reads import usable_nodes

    return to_digraph(match_prefix(usable_nodes(nodes, k, odd), k))


def graph_metrics(nodes: DataFrame, k: int = K) -> DataFrame:
    """``(counter, n)`` of the stages: nodes that can be used, k-mers at the ends and inside that go out,
    edges, nodes that have edges, and rows of the digraph."""
    from strandloom.operators.reads import usable_nodes

    reads = usable_nodes(nodes, k)
    edges = match_prefix(reads, k)
    one = lambda df, c, n=F.count("*"): df.agg(n.cast("long").alias("n")).select(F.lit(c).alias("counter"), "n")
    parts = [
        one(reads, "nodes"), one(anchors(reads, k, once=True), "anchors"), one(windows(reads, k, once=True), "windows"), one(edges, "edges"),
        one(edges.select("src").distinct(), "nodes_with_edges"), one(to_digraph(edges), "digraph_rows"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
