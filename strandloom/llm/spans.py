"""Long spans shared between records, found by recompression.

Every read is rewritten in rounds: runs of a symbol, then pairs of a left and a
right symbol, get a name. A name is a hash of what it stands for and a symbol's
side is a bit of its name, so all tasks give equal content equal names without
an exchange. Each symbol carries the stretch of letters that settles it: within
any window that holds this stretch the same symbol stands at the same place.
Of the highest symbols settled within a window the one of least hash stands for it, so
that neighbouring windows mostly have the same and go as one fragment; equal windows
have equal names, so only fragments of one name are compared, letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.vectors import BASE, chunks, flat, owners
from strandloom.operators.skew import hot_keys, salted_lookup
from strandloom.session import write_table

SPAN = 40
#: Rounds of naming. A symbol of the fourth rests on 26 letters in the median and seldom on fewer than
#: 17, which is enough to tell billions of places apart; one of the fifth on 36, so fewer windows have one in common.
ROUNDS = 4
CHUNK_ROWS = 1 << 12
#: Fragments that a task compares at once; more if a name has more.
COMPARED = 1 << 16
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _stretches(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of A, C, G, T within a row, span letters at least."""
    row = owners(offsets)
    good = BASE[data] < 4
    cut = np.concatenate([[True], (good[1:] != good[:-1]) | (row[1:] != row[:-1])]) if len(data) else np.zeros(0, bool)
    start = np.flatnonzero(cut)
    end = np.concatenate([start[1:], [len(data)]]) if len(start) else start
    keep = good[start] & (end - start >= span) if len(start) else np.zeros(0, bool)
    return start[keep], end[keep]


class _Symbols:
    """The symbols of all stretches after a round: name, first letter, stretch that settles it, owner."""

    def __init__(self, name, start, lo, hi, own):
        self.name, self.start, self.lo, self.hi, self.own = name, start, lo, hi, own

    def neighbours(self, first: np.ndarray, last: np.ndarray, edge_lo: np.ndarray, edge_hi: np.ndarray):
        """lo and hi of the symbols left and right of first..last; beyond an edge
        stands something unknown, one letter outside."""
        own = self.own[first]
        l_lo, l_hi = self.lo[first - 1], self.hi[first - 1]
        edge = np.flatnonzero(self.own[first - 1] != own)
        edge = np.union1d(edge, [0]) if len(first) else edge  # before the first symbol stands none
        l_lo[edge] = l_hi[edge] = edge_lo[own[edge]] - 1
        right = np.minimum(last + 1, len(self.own) - 1)
        r_lo, r_hi = self.lo[right], self.hi[right]
        edge = np.flatnonzero((self.own[right] != own) | (right == last))
        r_lo[edge] = r_hi[edge] = edge_hi[own[edge]] + 1
        return l_lo, l_hi, r_lo, r_hi


def _runs(s: _Symbols, lo: np.ndarray, hi: np.ndarray) -> _Symbols:
    n = len(s.name)
    head = np.concatenate([[True], (s.name[1:] != s.name[:-1]) | (s.own[1:] != s.own[:-1])])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [n]]) - 1
    l_lo, l_hi, r_lo, r_hi = s.neighbours(first, last, lo, hi)
    length = (last - first + 1).astype(np.uint64)
    name = np.where(length > 1, _mix(s.name[first] + length * _U(0x9E3779B97F4A7C15)), s.name[first])
    # lo and hi need not grow with the position
    low = np.minimum.reduceat(s.lo, first)
    high = np.maximum.reduceat(s.hi, first)
    low, high = np.minimum(low, np.minimum(l_lo, r_lo)), np.maximum(high, np.maximum(l_hi, r_hi))
    return _Symbols(name, s.start[first], low, high, s.own[first])


def _pairs(s: _Symbols, lo: np.ndarray, hi: np.ndarray, salt: int) -> _Symbols:
    n = len(s.name)
    left = (_mix(s.name + _U(salt)) & _U(1)).astype(bool)
    joined = np.zeros(n, bool)
    joined[:-1] = left[:-1] & ~left[1:] & (s.own[1:] == s.own[:-1])
    first = np.flatnonzero(~np.concatenate([[False], joined[:-1]]))
    pair = joined[first]
    last = first + pair
    l_lo, l_hi, r_lo, r_hi = s.neighbours(first, last, lo, hi)
    low, high = np.minimum(s.lo[first], s.lo[last]), np.maximum(s.hi[first], s.hi[last])
    name = np.where(pair, _mix(_mix(s.name[first]) * _U(3) + s.name[last]), s.name[first])
    alone_left, alone_right = ~pair & left[first], ~pair & ~left[first]
    # a single left symbol rests on what follows it, a single right one on what precedes it
    low = np.where(alone_left, np.minimum(low, r_lo), np.where(alone_right, np.minimum(low, l_lo), low))
    high = np.where(alone_left, np.maximum(high, r_hi), np.where(alone_right, np.maximum(high, l_hi), high))
    return _Symbols(name, s.start[first], low, high, s.own[first])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    odd = 0x9E3779B97F4A7C15
    inverse = pow(odd, -1, 1 << 64)
    up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (odd, inverse))
    return up, down


def settled(data: np.ndarray, start: np.ndarray, end: np.ndarray, span: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``span`` letters in the stretches: its first letter, and
    the name of what stands for it. Equal windows have equal names."""
    size = end - start
    own = np.repeat(np.arange(len(start), dtype=np.int32), size)
    inner = np.concatenate([[0], np.cumsum(size)])
    # letters are moved together, with a gap of one between stretches for what is unknown
    lo = inner[:-1] + 2 * np.arange(len(start)) + 1
    hi = lo + size
    at = np.arange(inner[-1]) - inner[:-1][own] + lo[own]
    letter = BASE[data[np.arange(inner[-1]) - inner[:-1][own] + start[own]]].astype(np.uint64)
    total = int(hi[-1] + 2)
    up, down = _powers(total)
    value = np.zeros(total, np.uint64)
    value[at] = _mix(letter + _U(11))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[:total])])

    many = np.maximum(size - span + 1, 0)
    begin = np.concatenate([[0], np.cumsum(many)])
    first = np.arange(begin[-1]) - np.repeat(begin[:-1] - lo, many)
    # a chunk has fewer than 2^31 letters, so half the bytes do for places
    place, lo4, hi4 = at.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32)
    levels, s = [], _Symbols(_mix(letter + _U(77)), place, place, place + np.int32(1), own)
    for r in range(1, rounds + 1):
        s = _pairs(_runs(s, lo4, hi4), lo4, hi4, r)
        # the windows within which each symbol is settled
        low, high = np.maximum(s.hi - span, lo[s.own]), np.minimum(s.lo, hi[s.own] - span)
        ok = low <= high
        if not ok.any():
            break
        stretch = (sums[s.hi[ok]] - sums[s.lo[ok]]) * down[s.lo[ok]]
        full = _mix(stretch + _mix(s.name[ok] + (s.start[ok] - s.lo[ok]).astype(np.uint64)) + (s.hi[ok] - s.lo[ok]).astype(np.uint64) * _U(1 << 8) + _U(r))
        shift = (begin[:-1] - lo)[s.own[ok]]
        levels.append((low[ok] + shift, high[ok] + shift + 1, full))
    none = np.iinfo(np.uint64).max
    name = np.full(len(first), none, np.uint64)
    for low, high, full in reversed(levels):
        open_ = np.concatenate([[0], np.cumsum(name == none)])
        some = open_[high] > open_[low]  # a window of theirs has no higher symbol
        low, n, full = low[some], (high - low)[some], full[some]
        window = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        fresh = name[window] == none
        np.minimum.at(name, window[fresh], np.repeat(full, n)[fresh])
    bare = name == none  # at worst a window stands for itself
    name[bare] = _mix((sums[first[bare] + span] - sums[first[bare]]) * down[first[bare]])
    return first - np.repeat(lo - start, many), name


def _sizes(span: int) -> tuple[int, int]:
    """Whole numbers of 31 letters that a fragment takes, and the windows it has at most: neighbours
    overlap, so what lies between its first and its last window lies in one of them."""
    words = -(-(span + 22) // 31)
    return words, min(31 * words - span + 1, span)


def _find(span: int, rounds: int):
    """Fragments: neighbouring windows of one name, their letters packed two bits each."""
    words, most = _sizes(span)
    fields = [("name", pa.int64()), ("rec", pa.int64()), ("no", pa.int64()), ("first", pa.int32()), ("n", pa.int32())]
    schema = pa.schema(fields + [(f"t{j}", pa.int64()) for j in range(words)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK_ROWS):
            data, offsets = flat(t["text"])
            start, end = _stretches(data, offsets, span)
            if not len(start):
                continue
            at, name = settled(data, start, end, span, rounds)
            row = np.searchsorted(offsets, at, side="right") - 1
            head = np.concatenate([[True], (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])])
            begin = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            f = np.flatnonzero((np.arange(len(at)) - begin) % most == 0)  # long ones are cut
            n = np.diff(np.concatenate([f, [len(at)]]))
            base = np.concatenate([BASE[data], np.zeros(31 * words, np.uint8)]) & 3
            packed, inside = [], n + span - 1
            for j in range(words):
                code = np.zeros(len(f), np.int64)
                for i in range(31 * j, 31 * (j + 1)):
                    code = (code << 2) | np.where(i < inside, base[at[f] + i], 0)
                packed.append(pa.array(code))
            cols = [pa.array(name[f].view(np.int64)), t["rec"].combine_chunks().take(pa.array(row[f])), t["no"].combine_chunks().take(pa.array(row[f]))]
            cols += [pa.array((at[f] - offsets[:-1][row[f]]).astype(np.int32)), pa.array(n.astype(np.int32)), *packed]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _spelled(t: pa.Table, span: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All windows of fragments: the row, the place in it, and the letters as whole numbers."""
    words, most = _sizes(span)
    packed = [t[f"t{j}"].to_numpy() for j in range(words)]
    letter = [(packed[i // 31] >> (2 * (30 - i % 31))) & 3 for i in range(31 * words)]
    n = t["n"].to_numpy()
    inside = np.arange(most)[None, :] < n[:, None]
    keys = []
    for j in range(0, span, 31):
        size = min(31, span - j)
        mask = (1 << 2 * size) - 1
        code = np.zeros(len(n), np.int64)
        for i in range(j, j + size - 1):
            code = (code << 2) | letter[i]
        columns = np.empty((len(n), most), np.int64)
        for i in range(most):
            code = ((code << 2) | letter[min(j + size - 1 + i, len(letter) - 1)]) & mask
            columns[:, i] = code
        keys.append(columns[inside])
    row, place = np.nonzero(inside)
    return row, place, keys


INTERVALS = "rec long, no long, start int, stop int"


def _ends(t: pa.Table, row: np.ndarray, place: np.ndarray, span: int) -> pa.RecordBatch:
    """What lies between the first and the last shared window of each fragment; row and place ascend."""
    f = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    last = np.concatenate([f[1:], [len(row)]]) - 1 if len(row) else row
    first = t["first"].to_numpy()[row[f]]
    here = pa.array(row[f])
    cols = [t["rec"].combine_chunks().take(here), t["no"].combine_chunks().take(here)]
    cols += [pa.array((first + place[f]).astype(np.int32)), pa.array((first + place[last] + span).astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, ["rec", "no", "start", "stop"])


def _compare(span: int):
    """Intervals of fragments that come in the order of their names."""

    def shared(t: pa.Table) -> pa.RecordBatch:
        name, rec = t["name"].to_numpy(), t["rec"].to_numpy()
        at = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        two = np.minimum.reduceat(rec, at) < np.maximum.reduceat(rec, at)  # names of one record tell nothing
        keep = np.repeat(two, np.diff(np.concatenate([at, [len(name)]])))
        t = t.filter(pa.array(keep))
        row, place, keys = _spelled(t, span)
        if not len(row):
            return _ends(t, row, place, span)
        order = np.lexsort(keys)
        new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
        at = np.flatnonzero(new)
        r = t["rec"].to_numpy()[row[order]]
        two = np.minimum.reduceat(r, at) < np.maximum.reduceat(r, at)
        hit = np.sort(order[np.repeat(two, np.diff(np.concatenate([at, [len(row)]])))])
        return _ends(t, row[hit], place[hit], span)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < COMPARED:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            name = t["name"].to_numpy()
            cut = int(np.searchsorted(name, name[-1]))  # the last name may go on
            if cut:
                yield shared(t.slice(0, cut).combine_chunks())
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
        if n:
            yield shared(pa.Table.from_batches(held).combine_chunks())

    return run


def _windows_of(span: int):
    """The windows of fragments as rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK_ROWS):
            row, place, keys = _spelled(t, span)
            here = pa.array(row)
            cols = [t["rec"].combine_chunks().take(here), t["no"].combine_chunks().take(here), pa.array((t["first"].to_numpy()[row] + place).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, keys)], ["rec", "no", "first", *(f"w{j}" for j in range(len(keys)))])

    return run


def _in_two(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur in two records; counts are combined before the shuffle."""
    ends = df.groupBy(*keys).agg(F.min("rec").alias("_a"), F.max("rec").alias("_b"))
    return ends.where("_a < _b").select(*keys)


def shared_intervals(texts: DataFrame, span: int = SPAN, rounds: int = ROUNDS, share: int | None = None) -> DataFrame:
    """``(rec, no, start, stop)``: intervals of the texts ``(rec, no, text)`` that together cover just
    the windows of ``span`` letters that occur verbatim in a text of another record.

    Fragments meet by name and are compared within the task; a name of more than 1/share of the
    fragments (see ``hot_keys``) goes window by window, combined before the shuffle and salted.
    """
    words, _ = _sizes(span)
    schema = "name long, rec long, no long, first int, n int, " + ", ".join(f"t{j} long" for j in range(words))
    fragments, _ = write_table(texts.mapInArrow(_find(span, rounds), schema), "fragments")
    hot = hot_keys(fragments, "name", share)
    is_hot = F.xxhash64("name").isin(hot)
    cold = fragments.where(~is_hot) if hot else fragments
    found = cold.repartition("name").sortWithinPartitions("name").mapInArrow(_compare(span), INTERVALS)
    if hot:
        keys = [f"w{j}" for j in range(-(-span // 31))]
        schema = "rec long, no long, first int, " + ", ".join(f"{w} long" for w in keys)
        windows, _ = write_table(fragments.where(is_hot).mapInArrow(_windows_of(span), schema), "windows")
        both = salted_lookup(windows, _in_two(windows, *keys), keys, share=share)
        found = found.unionByName(both.select("rec", "no", F.col("first").alias("start"), (F.col("first") + span).alias("stop")))
    return found


def shared_bases(
    nodes: DataFrame, key: str = "id", fields: tuple[str, ...] = ("read_f", "read_r"), span: int = SPAN, rounds: int = ROUNDS, share: int | None = None
) -> DataFrame:
    """``(id, shared_bases)`` of each record that shares a span with another one: the
    number of its letters that lie in shared windows of ``span`` letters.

    Rows with the same key are one record, the set of its distinct texts by field: a null text
    adds nothing, of different texts each counts. Rows with a null key are left out; shorter
    texts share nothing, nor do letters other than A, C, G, T; repeats within a record do not count.
    """
    names = [f"f{i}" for i in range(len(fields))]
    rows = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.struct(*(F.col(c).cast("string").alias(f) for c, f in zip(fields, names))).alias("c"))
    # written once: the numbers must not change if a task runs again
    heads = rows.groupBy("id").agg(F.min("c").alias("c"), F.max("c").alias("hi")).select("id", F.monotonically_increasing_id().alias("rec"), "c", (~F.col("c").eqNullSafe(F.col("hi"))).alias("several"))
    heads, _ = write_table(heads, "records")
    texts = lambda df, *more: df.select(*more, F.posexplode(F.array(*(F.col("c")[f] for f in names))).alias("no", "text")).where("text is not null")
    one = texts(heads.where("not several"), "rec").withColumn("no", F.col("no").cast("long"))
    # ids of several contents, as rows of their distinct texts
    more = texts(rows.join(heads.where("several").select("id", "rec"), "id"), "rec").distinct()
    more, _ = write_table(more.select("rec", F.monotonically_increasing_id().alias("no"), "text"), "texts")
    found = shared_intervals(one.unionByName(more), span, rounds, share)
    here = Window.partitionBy("rec", "no").orderBy("start")
    before = F.coalesce(F.max("stop").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.col("stop") - F.greatest("start", before), F.lit(0))
    bases = found.withColumn("fresh", fresh).groupBy("rec").agg(F.sum("fresh").alias("shared_bases"))
    return bases.join(heads.select("id", "rec"), "rec").select("id", "shared_bases")
