"""Column functions over DNA text: all plain expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge types in the order in which stages write them (fixed values).
EDGE_TYPES = ("ff", "fe", "fr", "ef", "rr", "re", "rf", "er")
BASES = "ACGT"
#: Directions and link types as seen from the other end (fixed values).
FLIPPED_DIRS = {"f": "r", "r": "f"}
FLIPPED_LINKS = {"ff": "rr", "rr": "ff", "fr": "rf", "rf": "fr", "fe": "re", "re": "fe"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; characters other than A, C, G, T are dropped."""
    return F.reverse(F.translate(F.regexp_replace(_col(seq), "[^ACGT]", ""), "ACGT", "TGCA"))


def is_dna(seq: Column | str) -> Column:
    return ~_col(seq).rlike("[^ACGT]")


def trim_n(seq: Column | str, mode: str = "keep") -> Column:
    """Without the N at the end; then, if n leading N are fewer than half of the rest,
    without them. Mode ``keep`` also cuts n letters from the end, as stored results
    of the stage have it; mode ``clean`` cuts the leading N only, however many."""
    s = F.regexp_replace(_col(seq), "N+$", "")
    if mode == "clean":
        return F.regexp_replace(s, "^N+", "")
    n = F.length(F.regexp_extract(s, "^N*", 0))
    return F.when((n > 0) & (F.length(s) - n > n), F.substring(s, n + 1, F.length(s) - 2 * n)).otherwise(s)


def _code(one: Column) -> Column:
    """The letter for one base or a pair: each base takes five letters, itself and its four pairs."""
    at = lambda c: F.instr(F.lit(BASES), c) - 1
    first = at(F.substring(one, 1, 1)) * 5
    return F.char(F.lit(65) + first + F.when(F.length(one) == 2, at(F.substring(one, 2, 1)) + 1).otherwise(0))


def encode_dna(seq: Column | str) -> Column:
    """Two bases a letter, four bases at a time; a group with any other character
    becomes the text ``null``."""


    def group(four: Column) -> Column:
        second = F.substring(four, 3, 2)
        return F.when(four.rlike("[^ACGT]"), F.lit("null")).otherwise(
            F.concat(_code(F.substring(four, 1, 2)), F.when(second == "", F.lit("")).otherwise(_code(second)))
        )

    return F.array_join(F.transform(F.regexp_extract_all(_col(seq), F.lit("(?s).{1,4}"), F.lit(0)), group), "")


def decode_dna(code: Column | str) -> Column:
    """The inverse of ``encode_dna``; a letter beyond T becomes the text ``null``."""

    def letter(c: Column) -> Column:
        n = F.ascii(c) - 65
        first = F.substring(F.lit(BASES), F.floor(n / 5).cast("int") + 1, F.lit(1))
        second = F.when(n % 5 == 0, F.lit("")).otherwise(F.substring(F.lit(BASES), (n % 5).cast("int"), F.lit(1)))
        return F.when(n.between(0, 19), F.concat(first, second)).otherwise(F.lit("null"))

    return F.array_join(F.transform(F.regexp_extract_all(_col(code), F.lit("(?s)."), F.lit(0)), letter), "")


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(_col(kmer), revcomp(kmer))


def clean_id(header: Column | str) -> Column:
    """Header of mate 1 as an id: space, ``:``, ``#`` and ``-`` become ``_``, then every
    ``@`` goes, then every ``/1``."""
    return F.replace(F.replace(F.translate(_col(header), " :#-", "____"), F.lit("@"), F.lit("")), F.lit("/1"), F.lit(""))


def mate_name(name: Column | str) -> Column:
    """``x_1`` for ``x_2`` and the reverse, else null."""
    c = _col(name)
    stem = F.substring(c, F.lit(1), F.length(c) - 2)
    return F.when(c.endswith("_1"), F.concat(stem, F.lit("_2"))).when(c.endswith("_2"), F.concat(stem, F.lit("_1")))


def _known(c: Column, table: dict[str, str], what: str) -> Column:
    out = None
    for a, b in table.items():
        out = F.when(c == a, F.lit(b)) if out is None else out.when(c == a, F.lit(b))
    return out.when(c.isNotNull(), F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)))


def flip_dir(direction: Column | str) -> Column:
    """f for r and the reverse; anything else but null is an error."""
    return _known(_col(direction), FLIPPED_DIRS, "direction")


def flip_link(link: Column | str) -> Column:
    """The type of the link seen from its other end; ef, er and unknown types are errors."""
    return _known(_col(link), FLIPPED_LINKS, "link type")


def checked_type(edge_type: Column | str) -> Column:
    """The edge type itself; an unknown one is an error."""
    return _known(_col(edge_type), {t: t for t in EDGE_TYPES}, "edge type")


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Insertions, deletions and substitutions between two texts; a null is an error."""
    a, b = _col(a), _col(b)
    return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("texts must not be null"))).otherwise(F.levenshtein(a, b))


def fast_compare(a: Column | str, b: Column | str) -> Column:
    """Whether two texts, cut to the shorter length n, are nearly equal.

    Beyond 1000 characters: of 100 blocks of n div 100 characters, and the rest
    from the last of them on, 90 at least are equal. Else: fewer than n / 10
    edits; two empty texts are not.
    """

    def judge(v: Column) -> Column:
        x, y, n = v["x"], v["y"], v["n"]
        step = F.floor(n / 100).cast("int")
        same = F.size(
            F.filter(F.sequence(F.lit(0), F.lit(99)), lambda i: F.substring(x, i * step + 1, step) == F.substring(y, i * step + 1, step))
        ) + F.when(F.substring(x, step * 99 + 1, n) == F.substring(y, step * 99 + 1, n), 1).otherwise(0)
        return F.when(n > 1000, same >= 90).otherwise(F.levenshtein(x, y) * 10 < n)

    def cut(v: Column) -> Column:
        n = F.least(F.length(v["a"]), F.length(v["b"]))
        return F.struct(F.substring(v["a"], F.lit(1), n).alias("x"), F.substring(v["b"], F.lit(1), n).alias("y"), n.alias("n"))

    return _once(_once(F.struct(_col(a).alias("a"), _col(b).alias("b")), cut), judge)


def _once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def str_concat(a: Column | str, b: Column | str, overlap: int | Column) -> Column:
    """a and what follows the overlap in b; the overlap is not compared. An error if
    either is shorter than it."""
    a, b = _col(a), _col(b)
    k = F.lit(overlap) if isinstance(overlap, int) else overlap
    short = (F.length(a) < k) | (F.length(b) < k)
    return F.when(short, F.raise_error(F.lit("text shorter than the overlap"))).otherwise(F.concat(a, F.substring(b, k + 1, F.length(b))))


def two_places(x: Column | str) -> Column:
    """A number with two places, halves rounded to even."""
    return F.call_function("format_number", _col(x), F.lit("0.00"))


def edge_text(dst: Column | str, overlap: Column | str) -> Column:
    return F.concat_ws("!", _col(dst), _col(overlap).cast("string"))


def count_pair_end(a: Column | str, b: Column | str) -> Column:
    """Elements of a, repeated ones too, whose mate is in b; 0 if either is null."""
    a, b = _col(a), _col(b)
    hits = F.size(F.filter(a, lambda x: F.coalesce(F.array_contains(b, mate_name(x)), F.lit(False))))
    return F.when(a.isNull() | b.isNull(), F.lit(0)).otherwise(hits)


def ordered_distinct(items: Column | str) -> Column:
    """First occurrences in their order."""
    return F.array_distinct(_col(items))


def pair_ends(mates: Column | str, own: Column | str) -> Column:
    """The mates of a node, or itself if it has none."""
    return F.coalesce(_col(mates), F.array(_col(own)))


def tail_text(node: Column | str, direction: Column | str, dist: Column | str) -> Column:
    """``id dir dist`` of where a walk stands."""
    return F.concat_ws(" ", _col(node), _col(direction), _col(dist).cast("string"))


def candidate_text(node: Column | str, overlap: Column | str, cov: Column | str) -> Column:
    """``id!overlap|cov`` of an edge candidate."""
    return F.concat(edge_text(node, overlap), F.lit("|"), _col(cov).cast("string"))


def overlap_info(message: Column | str, offset: int = 0) -> Column:
    """The struct of an overlap message: the fields after the tag ``O`` at ``offset`` of a
    tab-separated line; another tag is an error."""
    part = F.split(_col(message), "\t")
    at = lambda i: F.get(part, F.lit(offset + i))
    made = F.struct(at(1).alias("id"), at(2).alias("str"), at(3).alias("edge_type"), at(4).cast("int").alias("overlap_size"))
    return F.when(at(0) == "O", made).when(_col(message).isNotNull(), F.raise_error(F.lit("unknown message type")))


def overlap_text(info: Column | str) -> Column:
    """``type id overlap str`` of an overlap message."""
    c = _col(info)
    return F.concat_ws(" ", c["edge_type"], c["id"], c["overlap_size"].cast("string"), c["str"])
