"""Registered queries of the core, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import dna, fields
from strandloom.operators import consensus, edges, overlap, paths, reads, tree
from strandloom.plans import pipeline
from strandloom.session import scratch_path
from strandloom.sources import fastq, nodemsg, structural

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def read(spark: SparkSession, at: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{table}.parquet")


def _nodes(spark, at) -> DataFrame:
    return reads.usable_nodes(read(spark, at, "nodes"))


def _mates(spark, at) -> DataFrame:
    """All mates of ``read_pairs``, in upper case."""
    t = read(spark, at, "read_pairs")
    both = F.explode(F.array(F.struct(F.lit("f").alias("mate"), F.upper("seq_f").alias("s")), F.struct(F.lit("r").alias("mate"), F.upper("seq_r").alias("s"))))
    return t.select("read_no", both.alias("x")).select("read_no", "x.*").where("s is not null")


def _edges(spark, at) -> DataFrame:
    """Distinct links with two ends."""
    e = read(spark, at, "edges").where("src is not null and dst is not null")
    return e.select(*edges.EDGE).distinct()


def _read_f(spark, at) -> DataFrame:
    """The distinct mates 1 of the nodes: an id of several has a row for each."""
    t = read(spark, at, "nodes").where("id is not null and read_f is not null")
    return t.groupBy("id", "read_f").agg(F.min("cov").alias("cov"))


def _linked_reads(spark, at) -> DataFrame:
    """Each edge with the mate 1 and the coverage of the node that it leads to."""
    far = _read_f(spark, at).select(F.col("id").alias("dst"), "read_f", F.coalesce("cov", F.lit(1.0)).alias("cov"))
    return _edges(spark, at).join(far, "dst")


def _black(spark, at) -> DataFrame:
    """Black edges: the plain edges of an overlap below 30."""
    e = _linked_reads(spark, at).where("overlap < 30").where(F.col("edge_type").isin("ff", "fr", "rf", "rr"))
    return e.select(F.col("src").alias("id"), F.col("edge_type").alias("con"), F.col("dst").alias("node_id"), F.col("read_f").alias("seq"), F.col("overlap").alias("oval_size"), "cov")


def _gray(spark, at) -> DataFrame:
    e = _edges(spark, at).where("overlap between 30 and 40")
    return e.select(F.col("src").alias("id"), F.col("edge_type").alias("con"), F.col("dst").alias("node_id"))


def _ids(spark, at) -> DataFrame:
    return read(spark, at, "nodes").where("id is not null").select("id").distinct()


# raw deliveries


@query
def p2_found(spark: SparkSession, at: str) -> DataFrame:
    return structural.rejected(read(spark, at, "raw_blocks"))


@query
def p2_loaded(spark: SparkSession, at: str) -> DataFrame:
    return structural.loaded(read(spark, at, "raw_blocks"))


@query
def prep_reads(spark: SparkSession, at: str) -> DataFrame:
    return reads.prepare_reads(read(spark, at, "raw_blocks"))


@query
def prep_rejects(spark: SparkSession, at: str) -> DataFrame:
    return reads.judged(read(spark, at, "raw_blocks"), keep=("block_no",)).where("verdict != 'reads_good'").select("block_no", "verdict")


@query
def prep_metrics(spark: SparkSession, at: str) -> DataFrame:
    return reads.read_metrics(read(spark, at, "raw_blocks"))


@query
def normalize_ids(spark: SparkSession, at: str) -> DataFrame:
    first = F.get(reads.split_block(F.coalesce("fields_txt", F.lit(""))), F.lit(0))
    return read(spark, at, "raw_blocks").select("block_no", dna.clean_id(first).alias("id"))


# the same over the deliveries of both forms; pairs with odd letters stay


@query
def prep_reads_all(spark: SparkSession, at: str) -> DataFrame:
    return reads.prepare_deliveries(read(spark, at, "raw_blocks"))


@query
def prep_rejects_all(spark: SparkSession, at: str) -> DataFrame:
    return reads.judged_deliveries(read(spark, at, "raw_blocks")).where("verdict != 'reads_good'").select("block_no", "verdict")


@query
def prep_metrics_all(spark: SparkSession, at: str) -> DataFrame:
    return reads.delivery_metrics(read(spark, at, "raw_blocks"))


@query
def normalize_ids_all(spark: SparkSession, at: str) -> DataFrame:
    return read(spark, at, "raw_blocks").select("block_no", dna.clean_id(reads.first_value()).alias("id"))


def _pairs(spark, at) -> DataFrame:
    return structural.loaded(read(spark, at, "raw_blocks")).withColumnRenamed("name", "id").drop("block_no")


@query
def fastq_scan(spark: SparkSession, at: str) -> DataFrame:
    """The loaded pairs, written as FASTQ and read again through the source; splits of 4 KB cut
    every file inside its records."""
    path = scratch_path(spark, "fastq")
    fastq.write_fastq(_pairs(spark, at), path)
    return fastq.read_fastq(spark, path, splitSize=1 << 12)


@query
def fastq_gzip(spark: SparkSession, at: str) -> DataFrame:
    path = scratch_path(spark, "fastq")
    fastq.write_fastq(_pairs(spark, at), path, compression="gzip")
    return fastq.read_fastq(spark, path)


@query
def fastq_bzip2(spark: SparkSession, at: str) -> DataFrame:
    path = scratch_path(spark, "fastq")
    fastq.write_fastq(_pairs(spark, at), path, compression="bzip2")
    return fastq.read_fastq(spark, path)


@query
def fastq_malformed(spark: SparkSession, at: str) -> DataFrame:
    """Pairs with a line of junk before every other one: reading goes on at the next header."""
    path = scratch_path(spark, "fastq")
    record = fastq.record_text()
    junk = F.when(F.length("seq_f") % 2 == 0, F.concat(F.lit("no record\n"), record)).otherwise(record)
    _pairs(spark, at).select(junk.alias("value")).write.text(path)
    return fastq.read_fastq(spark, path, mode="DROPMALFORMED", splitSize=1 << 12)


@query
def fastq_line_cap(spark: SparkSession, at: str) -> DataFrame:
    """Pairs with a line of more than 60 characters are passed over."""
    path = scratch_path(spark, "fastq")
    fastq.write_fastq(_pairs(spark, at), path)
    return fastq.read_fastq(spark, path, mode="DROPMALFORMED", maxLineLength=60)


# scalar functions over reads


@query
def revcomp(spark: SparkSession, at: str) -> DataFrame:
    return _mates(spark, at).select("read_no", "mate", dna.revcomp("s").alias("rc"))


@query
def trim_n(spark: SparkSession, at: str) -> DataFrame:
    return _mates(spark, at).select("read_no", "mate", dna.trim_n("s").alias("trimmed"))


@query
def trim_n_clean(spark: SparkSession, at: str) -> DataFrame:
    return _mates(spark, at).select("read_no", "mate", dna.trim_n("s", "clean").alias("trimmed"))


@query
def encode_dna(spark: SparkSession, at: str) -> DataFrame:
    return _mates(spark, at).select("read_no", "mate", dna.encode_dna("s").alias("code"))


@query
def decode_dna(spark: SparkSession, at: str) -> DataFrame:
    ok = _mates(spark, at).where(dna.is_dna("s"))
    return ok.select("read_no", "mate", dna.decode_dna(dna.encode_dna("s")).alias("s"))


@query
def mate_name(spark: SparkSession, at: str) -> DataFrame:
    t = read(spark, at, "read_pairs")
    return t.select("read_no", dna.mate_name(F.concat("id", F.when(F.col("read_no") % 3 == 0, "_1").when(F.col("read_no") % 3 == 1, "_2").otherwise(""))).alias("mate"))


@query
def flip_dir(spark: SparkSession, at: str) -> DataFrame:
    plain = _edges(spark, at).where(F.col("edge_type").isin("ff", "fr", "rf", "rr"))
    return plain.select(*edges.EDGE, dna.flip_dir(F.substring("edge_type", 1, 1)).alias("flipped"))


@query
def flip_link(spark: SparkSession, at: str) -> DataFrame:
    return _edges(spark, at).where("edge_type not in ('ef', 'er')").select(*edges.EDGE, dna.flip_link("edge_type").alias("flipped"))


@query
def edge_types(spark: SparkSession, at: str) -> DataFrame:
    e = read(spark, at, "edges").select(dna.checked_type("edge_type").alias("edge_type"))
    return e.groupBy("edge_type").agg(F.count("*").alias("n"))


@query
def edit_distance(spark: SparkSession, at: str) -> DataFrame:
    near = _read_f(spark, at).select(F.col("id").alias("src"), F.col("read_f").alias("own"))
    return _linked_reads(spark, at).join(near, "src").select(*edges.EDGE, dna.edit_distance("own", "read_f").alias("distance"))


@query
def fast_compare(spark: SparkSession, at: str) -> DataFrame:
    """Texts against themselves with every digit changed: long ones by blocks, short ones by distance."""
    t = read(spark, at, "documents").where("text is not null")
    return t.select("doc_id", dna.fast_compare("text", F.translate("text", "0123456789", "9876543210")).alias("alike"))


@query
def str_concat(spark: SparkSession, at: str) -> DataFrame:
    near = _read_f(spark, at).select(F.col("id").alias("src"), F.col("read_f").alias("own"))
    ok = _linked_reads(spark, at).join(near, "src").where((F.length("own") >= F.col("overlap")) & (F.length("read_f") >= F.col("overlap")))
    return ok.select(*edges.EDGE, dna.str_concat("own", "read_f", F.col("overlap")).alias("merged"))


@query
def count_pair_end(spark: SparkSession, at: str) -> DataFrame:
    """Of each node: how many neighbours by ff, ending in _1, have their mate, ending in _2, among its neighbours by rr."""
    e = _edges(spark, at)
    a = e.where("edge_type = 'ff'").select(F.col("src").alias("id"), F.concat("dst", F.lit("_1")).alias("name"))
    b = e.where("edge_type = 'rr'").select(F.col("src").alias("id"), F.concat("dst", F.lit("_2")).alias("name"))
    return edges.count_pair_ends(a, b)


# k-mers and overlaps


@query
def kmer_anchors(spark: SparkSession, at: str) -> DataFrame:
    return overlap.anchors(_nodes(spark, at)).select("id", "kmer", "edge_type", "overlap")


@query
def kmer_windows(spark: SparkSession, at: str) -> DataFrame:
    return overlap.windows(_nodes(spark, at)).select("id", "kmer", "edge_type", "overlap")


@query
def canonical_kmers(spark: SparkSession, at: str) -> DataFrame:
    return overlap.canonical_kmers(_nodes(spark, at)).select("id", "kmer", "edge_type", "overlap", "is_anchor")


@query
def kmer_coverage(spark: SparkSession, at: str) -> DataFrame:
    return overlap.kmer_coverage(_nodes(spark, at))


@query
def high_freq_cap(spark: SparkSession, at: str) -> DataFrame:
    return overlap.cap_frequency(overlap.canonical_kmers(_nodes(spark, at)), 5).select("kmer", "id", "edge_type", "overlap", "is_anchor")


@query
def overlap_edges_full(spark: SparkSession, at: str) -> DataFrame:
    return overlap.match_prefix(_nodes(spark, at), mode="full")


@query
def overlap_edges_canonical(spark: SparkSession, at: str) -> DataFrame:
    return overlap.match_prefix(_nodes(spark, at))


@query
def mirror_removed_edges(spark: SparkSession, at: str) -> DataFrame:
    return overlap.remove_mirrors(overlap.match_prefix(_nodes(spark, at), mode="full"))


@query
def mirror_removed_links(spark: SparkSession, at: str) -> DataFrame:
    return overlap.remove_mirrors(_edges(spark, at))


@query
def digraph(spark: SparkSession, at: str) -> DataFrame:
    return overlap.to_digraph(overlap.match_prefix(_nodes(spark, at)))


@query
def digraph_degree(spark: SparkSession, at: str) -> DataFrame:
    return overlap.degree(overlap.match_prefix(_nodes(spark, at)))


# the same under the names that they had while the others left out pairs with odd letters


@query
def kmers_all(spark: SparkSession, at: str) -> DataFrame:
    return overlap.kmers(_nodes(spark, at)).select("id", "kmer", "edge_type", "overlap", "is_anchor")


@query
def kmer_counts_all(spark: SparkSession, at: str) -> DataFrame:
    return overlap.kmer_counts(_nodes(spark, at))


@query
def overlap_edges_all(spark: SparkSession, at: str) -> DataFrame:
    return overlap.match_prefix(_nodes(spark, at))


@query
def digraph_all(spark: SparkSession, at: str) -> DataFrame:
    return overlap.digraph(read(spark, at, "nodes"))


@query
def graph_metrics(spark: SparkSession, at: str) -> DataFrame:
    return overlap.graph_metrics(read(spark, at, "nodes"))


@query
def without_contained(spark: SparkSession, at: str) -> DataFrame:
    """The usable nodes but for those with contained reads."""
    held = edges.contained_reads(_edges(spark, at).withColumn("overlap", F.col("overlap") - 40))
    n = reads.usable_nodes(read(spark, at, "nodes").join(held, "id", "left"))
    return n.select("id", "seq_f", "seq_r")


@query
def p3_found(spark: SparkSession, at: str) -> DataFrame:
    return tree.prefix_stats(read(spark, at, "occurrences"))


# edges and nodes


@query
def link_degree(spark: SparkSession, at: str) -> DataFrame:
    return overlap.degree(_edges(spark, at))


@query
def has_edge(spark: SparkSession, at: str) -> DataFrame:
    """Which links are there from the other end, too."""
    e = _edges(spark, at)
    return edges.has_edge(e, e.select(F.col("dst").alias("src"), "edge_type", F.col("src").alias("dst"), "overlap"))


@query
def get_edge(spark: SparkSession, at: str) -> DataFrame:
    e = _edges(spark, at)
    return edges.get_edge(e, e.where("overlap >= 40"))


@query
def remove_link(spark: SparkSession, at: str) -> DataFrame:
    e = _edges(spark, at)
    return edges.remove_link(e, e.where("overlap % 3 = 0"))


@query
def remove_link_first(spark: SparkSession, at: str) -> DataFrame:
    e = _edges(spark, at)
    return edges.remove_link(e, e.where("overlap % 3 = 0").select("src", "edge_type", "dst"))


@query
def remove_link_update(spark: SparkSession, at: str) -> DataFrame:
    e = _edges(spark, at)
    return edges.remove_link(e, e.withColumn("overlap", F.col("overlap") + 1), missing="ignore")


def _changes(e: DataFrame) -> DataFrame:
    c = e.where("edge_type = 'ff' and overlap % 2 = 0")
    return c.select("src", F.col("edge_type").alias("old_type"), F.col("dst").alias("old_dst"), F.col("overlap").alias("old_overlap"), F.lit("fr").alias("new_type"), F.col("dst").alias("new_dst"), (F.col("overlap") + 1).alias("new_overlap"))


@query
def replace_link(spark: SparkSession, at: str) -> DataFrame:
    e = _edges(spark, at)
    return edges.replace_link(e, _changes(e))


@query
def replace_link_oval(spark: SparkSession, at: str) -> DataFrame:
    e = _edges(spark, at)
    return edges.replace_link(e, _changes(e), by_overlap=True)


@query
def contained_reads(spark: SparkSession, at: str) -> DataFrame:
    return edges.contained_reads(_edges(spark, at).withColumn("overlap", F.col("overlap") - 40))


@query
def black_degree(spark: SparkSession, at: str) -> DataFrame:
    return edges.black_degree(_black(spark, at))


@query
def keep_black(spark: SparkSession, at: str) -> DataFrame:
    return edges.keep_black(_black(spark, at), "f").select("id", "con", "node_id", "oval_size")


@query
def clear_black(spark: SparkSession, at: str) -> DataFrame:
    return edges.clear_black(_black(spark, at), "f").select("id", "con", "node_id", "oval_size")


@query
def keep_black_r(spark: SparkSession, at: str) -> DataFrame:
    return edges.keep_black(_black(spark, at), "r").select("id", "con", "node_id", "oval_size")


@query
def clear_black_r(spark: SparkSession, at: str) -> DataFrame:
    return edges.clear_black(_black(spark, at), "r").select("id", "con", "node_id", "oval_size")


@query
def merged_lists(spark: SparkSession, at: str) -> DataFrame:
    return edges.merged_lists(read(spark, at, "edges").where("src is not null and dst is not null")).drop("part")


@query
def pair_ends(spark: SparkSession, at: str) -> DataFrame:
    """Each node with the distinct nodes that it has e links to, or with itself."""
    e = _edges(spark, at).where(F.col("edge_type").isin("fe", "re"))
    mates = e.groupBy(F.col("src").alias("id")).agg(F.sort_array(dna.ordered_distinct(F.collect_list("dst"))).alias("mates"))
    return _ids(spark, at).join(mates, "id", "left").select("id", dna.pair_ends("mates", "id").alias("mates"))


@query
def is_black(spark: SparkSession, at: str) -> DataFrame:
    return edges.is_black(_ids(spark, at), _edges(spark, at), _black(spark, at))


@query
def is_gray(spark: SparkSession, at: str) -> DataFrame:
    return edges.is_gray(_ids(spark, at), _edges(spark, at), _black(spark, at), _gray(spark, at))


def _edge_maps(spark, at) -> DataFrame:
    """``(id, part, edges)``: the lists of each node by type."""
    lists = edges.merged_lists(_edges(spark, at)).withColumnRenamed("src", "id")
    return lists.groupBy("id", "part").agg(F.map_from_entries(F.collect_list(F.struct("edge_type", "links"))).alias("edges"))


@query
def node_message(spark: SparkSession, at: str) -> DataFrame:
    """Lines of all ids of nodes, with any reads or none: one for each content of an id. Of a hub whose lists
    come in parts the first line has the reads and the coverage, the others go on with its lists."""
    n = read(spark, at, "nodes").where("id is not null").groupBy("id", F.col("read_f").alias("seq_f"), F.col("read_r").alias("seq_r")).agg(F.min("cov").alias("cov"))
    first = F.coalesce("part", F.lit(0)) == 0
    n = n.join(_edge_maps(spark, at), "id", "left").withColumns({c: F.when(first, F.col(c)) for c in ("seq_f", "seq_r", "cov")})
    return nodemsg.node_lines(n.drop("part"))


@query
def node_parse(spark: SparkSession, at: str) -> DataFrame:
    """Nodes written as lines, read again: id, encoded pair, coverage, number of ff edges."""
    return _told(nodemsg.parse_node_lines(node_message(spark, at)))


def _told(p: DataFrame) -> DataFrame:
    return p.select("id", F.col("fields")["s"][0].alias("s"), F.col("fields")["v"][0].alias("v"), F.greatest(F.size(F.coalesce(F.try_element_at("fields", F.lit("ff")), F.array())), F.lit(0)).alias("n_ff"))


@query
def node_parse_only(spark: SparkSession, at: str) -> DataFrame:
    p = nodemsg.parse_node_lines(node_message(spark, at), only=["ff", "rr"])
    return p.select("id", F.explode("fields").alias("code", "values")).select("id", "code", F.array_join("values", ",").alias("list"))


@query
def node_message_all(spark: SparkSession, at: str) -> DataFrame:
    return node_message(spark, at)


@query
def node_parse_all(spark: SparkSession, at: str) -> DataFrame:
    return node_parse(spark, at)


@query
def node_parse_only_all(spark: SparkSession, at: str) -> DataFrame:
    return node_parse_only(spark, at)


@query
def node_file_scan(spark: SparkSession, at: str) -> DataFrame:
    """Node lines written as compressed text files and read again."""
    path = scratch_path(spark, "nodes")
    nodemsg.write_node_lines(node_message(spark, at), path, "gzip")
    return _told(nodemsg.read_node_lines(spark, path))


@query
def edges_tsv(spark: SparkSession, at: str) -> DataFrame:
    """The links written as compressed tab-separated text and read again."""
    path = scratch_path(spark, "tsv")
    pipeline.write_rows(_edges(spark, at), path, "tsv", "gzip")
    return spark.read.option("sep", "\t").schema("src string, edge_type string, dst string, overlap int").csv(path)


# fields of nodes


def _with_degrees(spark, at) -> DataFrame:
    """All ids with their numbers of edges in both directions and their least coverage."""
    d = overlap.degree(_edges(spark, at)).groupBy("id").agg(*(F.max(F.when(F.col("dir") == x, F.col("degree"))).alias(x) for x in "fr"))
    n = read(spark, at, "nodes").where("id is not null").groupBy("id").agg(F.min("cov").alias("cov"))
    return n.join(d, "id", "left").select("id", "cov", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("r", F.lit(0)).alias("r"))


@query
def node_flags(spark: SparkSession, at: str) -> DataFrame:
    """Flags of each node, set and read again: one edge in a direction can be compressed, a coverage of 2 or less is unique."""
    m = fields.set_flag(F.lit(None).cast(fields.EMPTY), "cf", F.col("f") == 1)
    m = fields.set_flag(fields.set_flag(m, "cr", F.col("r") == 1), "u", F.col("cov") <= 2)
    n = _with_degrees(spark, at).select("id", m.alias("m"))
    return n.select("id", *(fields.flag("m", c).alias(c) for c in ("cf", "cr", "u")))


@query
def compressible(spark: SparkSession, at: str) -> DataFrame:
    """The nodes whose flags let them be compressed in both directions."""
    return node_flags(spark, at).where("cf and cr").select("id")


@query
def node_colors(spark: SparkSession, at: str) -> DataFrame:
    """Colours by direction: W without edges, G with one, B with more; those of direction r are taken away where f has none."""
    color = lambda c: F.when(F.col(c) == 0, "W").when(F.col(c) == 1, "G").otherwise("B")
    n = _with_degrees(spark, at).withColumn("m", fields.put_one(fields.put_one(F.lit(None).cast(fields.EMPTY), "0", color("f")), "1", color("r")))
    n = n.withColumn("m", F.when(F.col("f") == 0, fields.clear("m", "1")).otherwise(F.col("m")))
    return n.select("id", fields.first("m", "0").alias("fcolor"), fields.first("m", "1").alias("rcolor"))


@query
def scalar_fields(spark: SparkSession, at: str) -> DataFrame:
    """Fields of one value: tag, direction to merge, replacement, coverage; set, set anew and read."""
    n = _with_degrees(spark, at)
    m = fields.put_one(fields.put_one(F.lit(None).cast(fields.EMPTY), "t", F.lit("first")), "t", F.concat("id", F.lit("_t")))
    m = fields.put_one(m, "m", F.when(F.col("f") > F.col("r"), "f").when(F.col("r") > F.col("f"), "r"))
    m = fields.put_one(fields.put_one(m, "r", F.when(F.col("f") > 1, F.col("id"))), "v", dna.two_places("cov"))
    n = n.withColumn("m", m)
    return n.select("id", *(fields.first("m", c).alias(name) for c, name in (("t", "mertag"), ("m", "merge_dir"), ("r", "replacement"), ("v", "coverage"))))


@query
def custom_fields(spark: SparkSession, at: str) -> DataFrame:
    """Fields of a name of one's own: set, added to, set anew, read and taken away."""
    n = _with_degrees(spark, at)
    n = n.withColumn("m", fields.append(fields.put_one(F.lit(None).cast(fields.EMPTY), "q", F.col("f")), "q", F.col("r")))
    n = n.withColumn("m", fields.put_one(fields.put_one("m", "z", F.lit("old")), "z", F.concat(F.lit("new"), F.col("f"))))
    n = n.withColumn("m", F.when(F.col("r") > 1, fields.clear("m", "q")).otherwise(F.col("m")))
    return n.select("id", fields.has("m", "q").alias("has_q"), F.array_join(fields.get("m", "q"), ",").alias("q"), fields.first("m", "z").alias("z"))


@query
def edge_lists(spark: SparkSession, at: str) -> DataFrame:
    """Edge lists of nodes: one more ff edge each, rr emptied, fe replaced by ef."""
    m = _edge_maps(spark, at).withColumnRenamed("edges", "m")
    m = m.withColumn("m", fields.append("m", "ff", F.concat(F.col("id"), F.lit("!21")))).withColumn("m", fields.put("m", "rr", F.array().cast("array<string>")))
    m = m.withColumn("m", fields.put("m", "fe", fields.get("m", "ef")))
    return m.select("id", F.explode("m").alias("code", "values")).select("id", "code", F.array_join("values", ",").alias("list"))


@query
def read_attributes(spark: SparkSession, at: str) -> DataFrame:
    """Attributes and contained reads of each node are sets: adding one twice adds it once."""
    n = _with_degrees(spark, at)
    m = F.lit(None).cast(fields.EMPTY)
    for c in ("f", "r"):
        m = fields.append_once(m, "I", F.concat(F.lit("d"), F.col(c)))
    n = n.withColumn("m", fields.append_once(fields.append_once(m, "n", F.col("id")), "n", F.col("id")))
    return n.select("id", F.array_join(fields.get("m", "I"), ",").alias("attributes"), F.array_join(fields.get("m", "n"), ",").alias("contained"))


@query
def edge_notes(spark: SparkSession, at: str) -> DataFrame:
    """Notes of nodes in their text forms, by code: gray and black edges, edges to adjust and to remove, tips to merge, bubbles."""
    e = _linked_reads(spark, at).where(F.col("edge_type").isin("ff", "fr", "rf", "rr"))
    cov, one = F.col("cov").cast("float"), F.substring("edge_type", 1, 1)
    kinds = {
        "g": ("overlap between 30 and 40", fields.note("edge_type", "dst")),
        "b": ("overlap < 30", fields.note("edge_type", "dst", "read_f", "overlap", cov, one)),
        "a": ("overlap % 3 = 1", fields.note("dst", one, "edge_type", "overlap")),
        "e": ("overlap % 3 = 0", fields.note("dst", one, "edge_type", "overlap")),
        "x": ("edge_type = 'ff'", fields.note("dst", cov, "src")),
        "p": ("edge_type = 'rr'", fields.note("src", one, "dst", one, "src", cov, "overlap")),
    }
    each = F.array_compact(F.array(*(F.when(F.expr(on), F.struct(F.lit(code).alias("code"), text.alias("note"))) for code, (on, text) in kinds.items())))
    return e.select(F.col("src").alias("id"), F.inline(each))


@query
def note_scan(spark: SparkSession, at: str) -> DataFrame:
    """Black edges read from their notes again."""
    b = edge_notes(spark, at).where("code = 'b'")
    return b.select("id", fields.note_parts("note", "con", "node_id", "str_raw", "oval_size", "cov", "end").alias("p")).select(
        "id", "p.con", "p.node_id", "p.str_raw", F.col("p.oval_size").cast("int").alias("oval_size"), F.col("p.cov").cast("float").alias("cov"), "p.end"
    )


@query
def tail_texts(spark: SparkSession, at: str) -> DataFrame:
    t = paths.tails(_edges(spark, at))
    return t.select("id", "dir", dna.tail_text("tail", "tail_dir", F.lit(1)).alias("tail"))


@query
def candidate_texts(spark: SparkSession, at: str) -> DataFrame:
    return _linked_reads(spark, at).select("src", "edge_type", dna.candidate_text("dst", "overlap", F.col("cov").cast("float")).alias("candidate"))


@query
def overlap_messages(spark: SparkSession, at: str) -> DataFrame:
    """Overlap messages written, read and shown."""
    message = F.concat_ws("\t", F.lit("O"), "dst", "read_f", "edge_type", F.col("overlap").cast("string"))
    return _linked_reads(spark, at).select("src", dna.overlap_text(dna.overlap_info(message)).alias("shown"))


# consensus and chains


@query
def consensus_majority(spark: SparkSession, at: str) -> DataFrame:
    items = _linked_reads(spark, at).select(F.col("src").alias("grp"), F.col("read_f").alias("seq"), F.col("cov").alias("weight"))
    return consensus.consensus_majority(items, (1, 2), (9, 10))


@query
def consensus_plurality(spark: SparkSession, at: str) -> DataFrame:
    items = _linked_reads(spark, at).select(F.col("src").alias("grp"), F.col("read_f").alias("seq"), F.col("cov").alias("weight"))
    return consensus.consensus_plurality(items, (9, 10))


@query
def select_black_edge(spark: SparkSession, at: str) -> DataFrame:
    return consensus.select_black_edge(_black(spark, at), "f")


@query
def select_black_edge_r(spark: SparkSession, at: str) -> DataFrame:
    return consensus.select_black_edge(_black(spark, at), "r")


@query
def tails(spark: SparkSession, at: str) -> DataFrame:
    return paths.tails(_edges(spark, at), _black(spark, at))


@query
def find_tails(spark: SparkSession, at: str) -> DataFrame:
    return paths.find_tails(_ids(spark, at), _edges(spark, at))


@query
def find_tails_black(spark: SparkSession, at: str) -> DataFrame:
    """Walks that neither leave a node in a direction with black edges nor enter a node with any."""
    return paths.find_tails(_ids(spark, at), _edges(spark, at), _black(spark, at))


@query
def find_tails_overlaps(spark: SparkSession, at: str) -> DataFrame:
    """The chains of the overlap graph itself, over its longest overlap between two nodes."""
    e = overlap.match_prefix(_nodes(spark, at)).where(F.col("edge_type").isin("ff", "rr"))
    e = e.groupBy("src", "edge_type", "dst").agg(F.max("overlap").alias("overlap")).select(*edges.EDGE)
    return paths.find_tails(_ids(spark, at), e)


def queries() -> dict[str, Query]:
    return dict(_ALL)
