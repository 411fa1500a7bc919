"""Raw deliveries of read pairs: load what is well formed, give a reason for the rest.

Records are found by structural indexing over the bytes of a whole batch: masks
of quotes, separators and line ends, and the parity of the quotes before each
byte, which tells the separators inside a quoted value from real ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.vectors import chunks, flat, owners, slices

SCHEMA = "block_no long, reason string, name string, seq_f string, qual_f string, seq_r string, qual_r string"
#: Blocks that are indexed at once.
BATCH_ROWS = 4096
#: Reasons in the order in which they are looked for.
REASONS = ("empty", "form", "arity", "header", "separator", "mate", "quoting", "bases", "quality", "tag")
#: Those without which a block has no values.
SHAPE = ("empty", "form", "arity", "quoting")

LF, CR, QUOTE, COMMA = 10, 13, 34, 44
_BLANK, _BASES, _QUALITY = (np.zeros(256, bool) for _ in range(3))
_BLANK[[9, LF, CR, 32]] = True
_BASES[list(b"ACGTNacgtn")] = True
_QUALITY[33:127] = True


def _before(mask: np.ndarray) -> np.ndarray:
    """How many set bytes stand before each position, and in all."""
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


def _last(at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One past the last of the sorted positions ``at`` in start..end, or start."""
    i = np.searchsorted(at, end) - 1
    found = at[np.maximum(i, 0)] + 1 if len(at) else start
    return np.where((i >= 0) & (found > start), found, start)


def _csv(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """quoting faults, counts of values, and starts and ends of the first five values."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    d = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    rec = owners(offsets)
    quote = d == QUOTE
    seen = _before(quote)
    inside = ((seen[:-1] - np.repeat(seen[offsets[:-1]], size)) & 1).astype(bool)
    comma = (d == COMMA) & ~inside
    first = np.zeros(len(d) + 1, bool)
    first[offsets[:-1]] = True
    before, after = np.concatenate([[False], comma[:-1]]), np.concatenate([comma[1:], [False]])
    quote_before, quote_after = np.concatenate([[False], quote[:-1]]), np.concatenate([quote[1:], [False]])
    opens_well = first[:-1] | before | (quote_before & ~first[:-1])
    closes_well = first[1:] | after | quote_after
    closes_well[offsets[1:][size > 0] - 1] = True
    wrong = quote & np.where(inside, ~closes_well, ~opens_well) | ((d == LF) | (d == CR)) & ~inside
    n = len(size)
    fault = np.bincount(rec[wrong], minlength=n) > 0
    fault |= ((seen[offsets[1:]] - seen[offsets[:-1]]) & 1).astype(bool)
    commas = np.flatnonzero(comma)
    values = np.bincount(rec[commas], minlength=n) + 1
    starts, ends = np.zeros((5, n), np.int64), np.zeros((5, n), np.int64)
    five = np.flatnonzero(values == 5)
    cut = commas[np.searchsorted(commas, offsets[:-1][five])[:, None] + np.arange(4)] if len(five) else np.zeros((0, 4), np.int64)
    starts[:, five] = np.concatenate([offsets[:-1][five][:, None], cut + 1], 1).T
    ends[:, five] = np.concatenate([cut, offsets[1:][five][:, None]], 1).T
    shift = start - offsets[:-1]
    return fault, values, starts + shift, ends + shift


def _lines(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counts of lines without the empty ones at the end; starts and ends of the first eight."""
    n = len(start)
    lf = np.flatnonzero(data == LF)
    lo, hi = np.searchsorted(lf, start), np.searchsorted(lf, end)
    count = hi - lo + 1
    first = np.concatenate([[0], np.cumsum(count)])
    rec, at = np.repeat(np.arange(n), count), np.arange(first[-1])
    nth = at - first[:-1][rec]
    pick = lambda i: lf[np.clip(i, 0, max(len(lf) - 1, 0))] if len(lf) else np.zeros(len(i), np.int64)
    s = np.where(nth == 0, start[rec], pick(lo[rec] + nth - 1) + 1)
    e = np.where(nth == count[rec] - 1, end[rec], pick(lo[rec] + nth))
    e = e - ((e > s) & (data[np.maximum(e - 1, 0)] == CR)) if len(data) else e
    lines = np.zeros(n, np.int64)
    np.maximum.at(lines, rec[e > s], nth[e > s] + 1)
    starts, ends = np.zeros((8, n), np.int64), np.zeros((8, n), np.int64)
    eight = np.flatnonzero(lines == 8)
    of = first[:-1][eight] + np.arange(8)[:, None]
    starts[:, eight], ends[:, eight] = s[of], e[of]
    return lines, starts, ends


def _clean(names: pa.Array) -> pa.Array:
    for a, b in ((" ", "_"), (":", "_"), ("#", "_"), ("-", "_"), ("@", ""), ("/1", "")):
        names = pc.replace_substring(names, a, b)
    return names


def _index(t: pa.Table, shape_only: bool = False) -> pa.Table:
    data, offsets = flat(t["fields_txt"])
    start, end = offsets[:-1], offsets[1:]
    n = t.num_rows
    reason = np.zeros(n, np.int64)  # 0 is well formed, else 1 + its place in REASONS

    def fail(which: np.ndarray, why: str) -> None:
        if shape_only and why not in SHAPE:
            return
        reason[which & (reason == 0)] = 1 + REASONS.index(why)

    blank = _before(~_BLANK[data])
    fail(blank[end] == blank[start], "empty")
    form = t["form"].to_numpy(zero_copy_only=False)
    is_lines, is_csv = form == "lines", form == "csv"
    fail(~is_lines & ~is_csv, "form")

    count, ls, le = _lines(data, start, end)
    fail(is_lines & (count != 8), "arity")
    byte = lambda at: data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(n, np.uint8)
    begins = lambda k, c: (le[k] > ls[k]) & (byte(ls[k]) == ord(c))
    fail(is_lines & ~(begins(0, "@") & begins(4, "@")), "header")
    fail(is_lines & ~(begins(2, "+") & begins(6, "+")), "separator")
    tail = lambda k, c: (le[k] - ls[k] >= 2) & (byte(np.maximum(le[k] - 2, 0)) == ord("/")) & (byte(np.maximum(le[k] - 1, 0)) == ord(c))
    mates = tail(0, "1") & tail(4, "2") & (le[0] - ls[0] == le[4] - ls[4])
    alike = pc.equal(slices(data, ls[0], np.maximum(le[0] - 2, ls[0])), slices(data, ls[4], np.maximum(le[4] - 2, ls[4])))
    fail(is_lines & ~(mates & alike.to_numpy(zero_copy_only=False)), "mate")

    csv = np.flatnonzero(is_csv & (reason == 0))
    cut = _last(np.flatnonzero((data != LF) & (data != CR)), start[csv], end[csv])
    fault, values, cs, ce = _csv(data, start[csv], cut)
    whole = np.zeros(n, bool)
    whole[csv[fault]] = True
    fail(whole, "quoting")
    whole[:] = False
    whole[csv[values != 5]] = True
    fail(whole, "arity")

    vs, ve = np.zeros((5, n), np.int64), np.zeros((5, n), np.int64)
    for k, line in enumerate((0, 1, 3, 5, 7)):
        vs[k], ve[k] = np.where(is_lines, ls[line], 0), np.where(is_lines, le[line], 0)
        vs[k, csv], ve[k, csv] = cs[k], ce[k]
    quoted = is_csv & (ve > vs) & (data[np.minimum(vs, len(data) - 1)] == QUOTE) if len(data) else np.zeros((5, n), bool)
    vs, ve = vs + quoted, ve - quoted
    bad_base, bad_quality = _before(~_BASES[data]), _before(~_QUALITY[data])
    ve = np.maximum(ve, vs)
    for k, bad, why in ((1, bad_base, "bases"), (3, bad_base, "bases"), (2, bad_quality, "quality"), (4, bad_quality, "quality")):
        fail((ve[k] == vs[k]) | (bad[np.minimum(ve[k], len(data))] != bad[np.minimum(vs[k], len(data))]), why)

    live = reason == 0
    fields = []
    for k in range(5):
        v = slices(data, np.where(live, vs[k], 0), np.where(live, ve[k], 0))
        fields.append(pc.if_else(pa.array(quoted[k]), pc.replace_substring(v, '""', '"'), v))
    name = _clean(fields[0])
    tag = t["tag"].combine_chunks()
    tag = (pa.concat_arrays(tag.chunks) if isinstance(tag, pa.ChunkedArray) else tag).cast(pa.string())
    same = pc.fill_null(pc.and_(pc.equal(name, tag), pc.not_equal(name, "")), False)
    fail(~same.to_numpy(zero_copy_only=False), "tag")

    why = pa.array(["", *REASONS]).take(pa.array(reason))
    ok = pa.array(reason == 0)
    none = pa.nulls(n, pa.string())
    return pa.table(
        [t["block_no"].cast(pa.int64()), pc.if_else(ok, none, why), *(pc.if_else(ok, v, none) for v in (name, *fields[1:]))],
        names=["block_no", "reason", "name", "seq_f", "qual_f", "seq_r", "qual_r"],
    )


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches, BATCH_ROWS):
        yield from _index(t).to_batches()


def _run_shape(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches, BATCH_ROWS):
        yield from _index(t, shape_only=True).to_batches()


def load_blocks(blocks: DataFrame, shape_only: bool = False) -> DataFrame:
    """Every block of ``(block_no, form, fields_txt, tag)`` as one row: either
    ``reason`` is null and name, bases and qualities hold its values, or ``reason``
    is the first fault found and they are null.

    Null or blank text is ``empty``; a form other than lines and csv is ``form``;
    a null tag is a ``tag`` fault; a block delivered twice gives two rows; an
    empty table gives none; other columns are ignored. Values are byte ranges of
    any length. One pass without a shuffle. With ``shape_only`` only the faults of SHAPE
    count: eight lines or five values are enough, whatever they hold.
    """
    t = blocks.select(
        F.col("block_no").cast("long").alias("block_no"), F.col("form").cast("string").alias("form"),
        F.col("fields_txt").cast("string").alias("fields_txt"), F.col("tag").cast("string").alias("tag"),
    )
    return t.mapInArrow(_run_shape if shape_only else _run, SCHEMA)


def rejected(blocks: DataFrame) -> DataFrame:
    """``(block_no, reason)`` of the blocks with a fault."""
    return load_blocks(blocks).where("reason is not null").select("block_no", "reason")


def loaded(blocks: DataFrame) -> DataFrame:
    """``(block_no, name, seq_f, qual_f, seq_r, qual_r)`` of the others."""
    return load_blocks(blocks).where("reason is null").drop("reason")
