"""Near-duplicate records: deletion-variant signatures, equality join, exact check."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.vectors import chunks, flat, owners
from strandloom.llm.dictionary import holds_base, letters
from strandloom.operators.skew import salted_lookup
from strandloom.session import write_table

#: Letters of a shingle; the alphabet is A to Z, so 13 fit into 63 bits.
SHINGLE = 10
#: The signature: so many segments of so many values. Records match if one segment
#: differs in one value at most. At similarity 0.6 a segment does with probability
#: 0.475, so a pair is missed with probability 0.525 ** 24 < 2e-7, above it less.
SEGMENTS, VALUES = 24, 4
CHUNK_ROWS = 1 << 12
#: Shingles whose hashes are made at once.
CELLS = 1 << 18
#: Texts of a variant that are paired within a task; of more so many meet in one block.
GROUP, BLOCK = 1 << 7, 1 << 10
#: Rows that a task pairs at once.
PAIRED = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(t: pa.Table, names: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all places of the contents, as two vectors."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for name in names:
        data, offsets = flat(t[name])
        if len(data) < size:
            continue
        row = owners(offsets)
        at = np.flatnonzero(row[: len(data) - size + 1] == row[size - 1 :])
        code = np.zeros(len(at), np.int64)
        for j in range(size):
            code = code * 26 + (data[at + j] - 65)
        rows.append(row[at])
        found.append(code)
    return np.concatenate(rows), np.concatenate(found)


def _ordered(row: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """In the order of row, then shingle; as one number, where both fit into it."""
    bits = (26**size).bit_length()
    if bits + CHUNK_ROWS.bit_length() > 63:
        order = np.lexsort((code, row))
        return row[order], code[order]
    both = np.sort(row << bits | code)
    return both >> bits, both & ((1 << bits) - 1)


def _distinct(row: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    row, code = _ordered(row, code, size)
    keep = np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, bool)
    return row[keep], code[keep]


def _signatures(size: int, segments: int, values: int):
    odd = _mix(np.arange(1, segments * values + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    add = _mix(np.arange(10_001, 10_001 + segments * values, dtype=np.uint64)).astype(np.uint32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK_ROWS):
            n = t.num_rows
            row, code = _shingles(t, ["a", "b"], size)
            code = code[np.argsort(row, kind="stable")]  # one that repeats does not change a minimum
            count = np.bincount(row, minlength=n)
            full = np.flatnonzero(count)
            least = np.zeros((segments * values, len(full)), np.uint32)
            if len(full):
                at = np.concatenate([[0], np.cumsum(count[full])])[:-1]
                base = (_mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
                held = count[full]
                # texts of like numbers of shingles side by side, short ones padded with their last
                bucket = np.ceil(2 * np.log2(held)).astype(int)
                for b in np.unique(bucket):
                    same = np.flatnonzero(bucket == b)
                    width = int(held[same].max())
                    for part in np.array_split(same, max(1, -(-len(same) * width // CELLS))):
                        x = base[at[part] + np.minimum(np.arange(width)[:, None], held[part] - 1)]
                        for i in range(segments * values):
                            least[i, part] = (x * odd[i] + add[i]).min(0)
            rep = t["rep"].to_numpy()[full]
            for s in range(segments):
                part = least[s * values : (s + 1) * values]
                for gone in range(values):  # the variant in which one value may be anything
                    h = np.full(len(full), np.uint64(s * values + gone + 1))
                    for j in range(values):
                        if j != gone:
                            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + part[j])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rep)], ["sig", "rep"])

    return run


def _verify(size: int, over: int, under: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK_ROWS):
            n = t.num_rows
            (ra, ca), (rb, cb) = (_distinct(*_shingles(t, [f"{s}_a", f"{s}_b"], size), size) for s in "ab")
            row, code = _ordered(np.concatenate([ra, rb]), np.concatenate([ca, cb]), size)
            same = (row[1:] == row[:-1]) & (code[1:] == code[:-1])
            shared = np.bincount(row[1:][same], minlength=n)
            union = np.bincount(row, minlength=n) - shared
            ok = pa.array(under * shared >= over * union)
            yield from t.select(["rep_a", "rep_b"]).filter(ok).to_batches()

    return run


def classes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts ``(rep, a, b)``, one for each class of copies, under its smallest
    read_no, and membership ``(read_no, rep)``."""
    t = pairs.select(F.col("read_no").cast("long").alias("read_no"), letters("seq_f").alias("x"), letters("seq_r").alias("y"))
    t = t.where("read_no is not null and x is not null and y is not null").where(holds_base(F.col("x")) & holds_base(F.col("y")))
    t = t.select("read_no", F.concat_ws("|", F.least("x", "y"), F.greatest("x", "y")).alias("content"))
    t, _ = write_table(t, "contents")
    reps, _ = write_table(t.groupBy("content").agg(F.min("read_no").alias("rep")), "classes")
    texts = reps.select("rep", F.substring_index("content", "|", 1).alias("a"), F.substring_index("content", "|", -1).alias("b"))
    return texts, salted_lookup(t, reps, "content").select("read_no", "rep")


def _pair_up(most: int):
    """From rows ``(sig, rep)`` in the order of sig the pairs ``(null, rep_a, rep_b)`` of each sig of
    at most ``most`` texts; rows of others go out as ``(sig, rep, null)``, as they come."""
    names = ["sig", "rep_a", "rep_b"]

    def rows(sig: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(rep), pa.nulls(len(rep), pa.int64())], names)

    def pairs(sig: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([at, [len(sig)]]))
        big = np.repeat(n > most, n)
        if big.any():
            yield rows(sig[big], rep[big])
        after = np.repeat(at + n, n) - np.arange(len(sig)) - 1  # those behind it in its group
        after[big] = 0
        group = np.cumsum(after) >> 20
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(sig) else []
        for a, b in zip(cut, [*cut[1:], len(sig)]):
            first = np.repeat(np.arange(a, b), after[a:b])
            nth = np.arange(len(first)) - np.repeat(np.cumsum(after[a:b]) - after[a:b], after[a:b])
            x, y = rep[first], rep[first + nth + 1]
            x, y = np.minimum(x, y), np.maximum(x, y)
            x, y = x[x < y], y[x < y]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(x), pa.array(y)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, rep, big = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for t in chunks(batches, PAIRED):
            s, r = t["sig"].to_numpy(), t["rep"].to_numpy()
            if big is not None:  # the rest of a sig that was too large before
                n = int(np.searchsorted(s, big, "right"))
                yield rows(s[:n], r[:n])
                s, r = s[n:], r[n:]
            if not len(s):
                continue
            big = None
            sig, rep = np.concatenate([sig, s]), np.concatenate([rep, r])
            cut = int(np.searchsorted(sig, sig[-1]))  # the last one may go on
            yield from pairs(sig[:cut], rep[:cut])
            sig, rep = sig[cut:], rep[cut:]
            if len(sig) > most:
                big = sig[-1]
                yield rows(sig, rep)
                sig, rep = sig[:0], rep[:0]
        yield from pairs(sig, rep)

    return run


def _met(sigs: DataFrame, most: int = GROUP, block: int = BLOCK) -> DataFrame:
    """Distinct pairs ``(rep_a, rep_b)``, rep_a < rep_b, of the reps that a variant ``(sig, rep)`` brings together.

    Variants of few texts are paired in the task that gets them, in the order of sig. Those of
    more than ``most`` are joined with themselves in blocks: one side is dealt over as many
    salts as the variant has ``block`` texts, the other repeated in each.
    """
    schema = "sig long, rep_a long, rep_b long"
    met, _ = write_table(sigs.repartition("sig").sortWithinPartitions("sig").mapInArrow(_pair_up(most), schema).distinct(), "met")
    pairs, big = met.where("rep_b is not null").select("rep_a", "rep_b"), met.where("rep_b is null").select("sig", "rep_a")
    if big.isEmpty():
        return pairs
    salts = big.groupBy("sig").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    some, _ = write_table(salted_lookup(big, salts, "sig"), "big")
    a = some.select("sig", "rep_a", F.pmod(F.xxhash64("rep_a"), F.col("salts")).cast("int").alias("salt"))
    b = some.select("sig", F.col("rep_a").alias("rep_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return pairs.unionByName(a.join(b.hint("merge"), ["sig", "salt"]).where("rep_a < rep_b").select("rep_a", "rep_b")).distinct()


def similar_classes(
    texts: DataFrame, shingle: int = SHINGLE, over: int = 6, under: int = 10, segments: int = SEGMENTS, values: int = VALUES
) -> DataFrame:
    """Pairs ``(rep_a, rep_b)``, rep_a < rep_b, of the texts whose sets of shingles
    have a similarity of over/under at least; of texts without a shingle see ``bare_classes``.

    Each text gets a signature of ``segments`` segments of ``values`` minima of
    hashed shingles. A segment is indexed under each variant that leaves one
    value open, texts meet by equality of a variant, and the sets of those that
    meet are compared exactly, so no pair comes out wrongly.
    """
    met = _met(texts.mapInArrow(_signatures(shingle, segments, values), "sig long, rep long"))
    for side in "ab":
        own = texts.select(F.col("rep").alias(f"rep_{side}"), F.col("a").alias(f"{side}_a"), F.col("b").alias(f"{side}_b"))
        met = met.join(own, f"rep_{side}")
    return met.mapInArrow(_verify(shingle, over, under), "rep_a long, rep_b long")


def bare_classes(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The ``rep`` of the texts shorter than a shingle: their sets are empty, which makes them alike
    to each other and to no other text."""
    return texts.where((F.length("a") < shingle) & (F.length("b") < shingle)).select("rep")


def _all_of(bare: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs of the bare classes, in blocks; there is one group of them and each pair is asked for."""
    salts = max(1, -(-bare.count() // block))
    a = bare.select(F.col("rep").alias("rep_a"), F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int").alias("salt"))
    b = bare.select(F.col("rep").alias("rep_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return a.join(b, "salt").where("rep_a < rep_b").select("rep_a", "rep_b")


def near_duplicates(pairs: DataFrame, **how) -> DataFrame:
    """``(read_a, read_b)``, read_a < read_b: all rows of similar classes that are not
    copies of each other. Rows with a null mate or a mate without a base are left
    out, so are those with a null read_no; an empty table gives no rows."""
    texts, members = classes(pairs)
    members, _ = write_table(members, "members")
    bare, _ = write_table(bare_classes(texts, how.get("shingle", SHINGLE)), "bare")
    linked, _ = write_table(similar_classes(texts, **how).unionByName(_all_of(bare)), "linked")
    a, b = (members.select(F.col("rep").alias(f"rep_{s}"), F.col("read_no").alias(f"r{s}")) for s in "ab")
    rows = linked.join(a, "rep_a").join(b, "rep_b")
    return rows.select(F.least("ra", "rb").alias("read_a"), F.greatest("ra", "rb").alias("read_b"))


def linked_classes(pairs: DataFrame, **how) -> DataFrame:
    """One row a record: ``(read_no, class_no, links)``: its class of copies and the
    number of other classes that are similar to it."""
    texts, members = classes(pairs)
    members, _ = write_table(members, "members")
    bare, _ = write_table(bare_classes(texts, how.get("shingle", SHINGLE)), "bare")
    linked = similar_classes(texts, **how)
    ends = linked.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    ends = ends.unionByName(bare.select("rep", F.lit(bare.count() - 1).cast("long").alias("links")))
    return salted_lookup(members, ends, "rep", how="left").select(
        "read_no", F.col("rep").alias("class_no"), F.coalesce("links", F.lit(0)).cast("long").alias("links")
    )
