"""Evaluation passages in a corpus: Wu-Manber search for many patterns of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.vectors import chunks
from strandloom.session import drop_at_end, files_at, scratch_path, write_table

#: Words in a row that make a leak.
RUN = 13
#: Words of a block of the shift table, and of the suffix that picks a bucket.
BLOCK, SUFFIX = 2, 4
CHUNK_ROWS = 1 << 12
#: Window ends that one lane of the search steps over; a long text takes many lanes.
LANE = 512
#: Bytes of item text in one part of the index: a task holds one part at a time, some six times as large.
INDEX_BYTES = 8 << 20
#: Words of an item that stay together, with those of a run in common between two pieces.
PIECE = 1 << 14
#: Bytes of corpus words that a task searches for all parts in turn.
HELD_BYTES = 32 << 20
#: Candidates that are compared at once.
BLOCK_ROWS = 1 << 18
#: Bytes of an array of the index in one stored row.
STORED = 1 << 22
_ODD = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts, which are the runs of a-z and 0-9 of the lower-cased text: ``norm``
    has them with one blank behind each, from ``start`` to ``end``; ``token`` is a hash of each;
    those of text i are at offsets[i]:offsets[i + 1]."""

    def __init__(self, texts: list[str | None]):
        lowered = [(x.lower() if x else "").encode("utf-8", "replace") + b"\n" for x in texts]
        data = np.frombuffer(b"".join(lowered), np.uint8)
        letter = _WORD[data]
        after = ~letter  # what first follows a word
        after[1:] &= letter[:-1]
        after[:1] = False
        self.norm = np.where(letter, data, np.uint8(32))[letter | after]
        self.end = np.flatnonzero(self.norm == 32).astype(np.int32)
        self.start = np.concatenate([np.zeros(1, np.int32), self.end[:-1] + 1])[: len(self.end)].astype(np.int32)
        size = np.fromiter(map(len, lowered), np.int64, len(lowered))
        self.offsets = np.concatenate([[0], np.cumsum(after)[np.cumsum(size) - 1]]) if len(texts) else np.zeros(1, np.int64)
        cut = np.flatnonzero(np.diff(self.start >> 20, prepend=-1)) if len(self.start) else []
        some = [self._hashes(a, b) for a, b in zip(cut, [*cut[1:], len(self.start)])]
        self.token = np.concatenate([np.zeros(0, np.uint64), *some])

    def _hashes(self, a: int, b: int) -> np.ndarray:
        """Hashes of the words a to b."""
        at = int(self.start[a])
        start, end = self.start[a:b] - at, self.end[a:b] - at
        n = int(end[-1])
        up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _ODD, np.uint64))])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.norm[at : at + n].astype(np.uint64) + np.uint64(1)) * up[:n])])
        down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, pow(_ODD, -1, 1 << 64), np.uint64))])
        return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _hash(tokens: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n tokens that end at each of ``at``."""
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = (h ^ tokens[at - j]) * np.uint64(_ODD)
        h ^= h >> np.uint64(29)
    return h


def _expand(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers begin..begin+size of each row, and the row of each."""
    row = np.repeat(np.arange(len(size)), size)
    return np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + begin[row], row


def _slices(size: np.ndarray) -> Iterator[slice]:
    """Rows in groups whose sizes come to about BLOCK_ROWS."""
    group = np.cumsum(size) // BLOCK_ROWS
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(size) else []
    yield from (slice(a, b) for a, b in zip(cut, [*cut[1:], len(size)]))


def _same_bytes(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Which a[a0:a1] equal b[b0:b1]."""
    same = a1 - a0 == b1 - b0
    size = np.where(same, a1 - a0, 0).astype(np.int64)
    for s in _slices(size >> 4):
        at, row = _expand(a0[s].astype(np.int64), size[s])
        differ = a[at] != b[at + (b0[s].astype(np.int64) - a0[s])[row]]
        same[s] &= np.bincount(row[differ], minlength=s.stop - s.start) == 0
    return same


class Index:
    """Shift table and suffix buckets of all runs of ``run`` words of the items. Its size goes with
    the number of words: a token, two ends, a run, a bucket key and a few bytes of the table each."""

    ARRAYS = (("norm", np.uint8), ("start", np.int32), ("end", np.int32), ("token", np.uint64), ("shift", np.uint8), ("runs", np.int32), ("keys", np.uint32), ("sets", np.int32), ("begin", np.int32), ("members", np.int32), ("ids", np.int64))

    def __init__(self, run: int, arrays: dict[str, np.ndarray]):
        self.run, self.block, self.suffix = run, min(BLOCK, run), min(SUFFIX, run)
        for name, _ in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.bits = len(self.shift).bit_length() - 1

    @classmethod
    def build(cls, items: list[int], texts: list[str], run: int) -> Index:
        w = Words(texts)
        block, suffix = min(BLOCK, run), min(SUFFIX, run)
        n = np.diff(w.offsets)
        text = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(text)) - w.offsets[:-1][text]
        at = np.flatnonzero(nth < n[text] - run + 1)  # a run starts here
        whole = np.zeros(len(at), np.uint64)
        for j in range(run):
            whole = _mix(whole + w.token[at + j])
        order = np.argsort(whole, kind="stable")
        at, whole = at[order], whole[order]
        head = np.concatenate([[True], whole[1:] != whole[:-1]]) if len(at) else np.zeros(0, bool)
        rep = at[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(at) else at
        equal = _same_bytes(w.norm, w.start[at], w.end[at + run - 1], w.norm, w.start[rep], w.end[rep + run - 1])
        rep = np.where(equal, rep, at)  # runs of one hash that differ stand for themselves
        ids, number = np.unique(np.asarray(items, np.int64), return_inverse=True)
        item = number[text[at]]
        both = np.unique(rep.astype(np.int64) << 32 | item)
        rep, item = both >> 32, (both & 0xFFFFFFFF).astype(np.int32)
        runs, count = np.unique(rep, return_counts=True)
        begin = np.cumsum(count) - count
        # runs of the same items share one list of them
        sums = np.add.reduceat(_mix(item.astype(np.uint64) + np.uint64(1)), begin) if len(runs) else np.zeros(0, np.uint64)
        _, one, sets = np.unique(_mix(sums + count.astype(np.uint64)), return_index=True, return_inverse=True)
        equal = _same_bytes(item, begin, begin + count, item, begin[one[sets]], (begin + count)[one[sets]])
        odd = np.flatnonzero(~equal)  # of one hash with others, but not of one list
        sets[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate([one, odd]).astype(np.int64)
        members, _ = _expand(begin[one], count[one])
        key = (_hash(w.token, runs + run - 1, suffix) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(key, kind="stable")
        # a block of words may stand at most so near the end of a run
        inner = np.flatnonzero((nth >= block - 1) & (n[text] >= run))
        h = _hash(w.token, inner, block)
        bits = max(8, int(4 * len(np.unique(h))).bit_length())
        shift = np.full(1 << bits, run - block + 1, np.uint8)
        np.minimum.at(shift, (h >> np.uint64(64 - bits)).astype(np.int64), (run - 1 - np.minimum(nth[inner], run - 1)).astype(np.uint8))
        return cls(run, dict(
            norm=w.norm, start=w.start, end=w.end, token=w.token, shift=shift, runs=runs[order].astype(np.int32), keys=key[order],
            sets=sets[order].astype(np.int32), begin=np.concatenate([[0], np.cumsum(count[one])]).astype(np.int32), members=item[members], ids=ids,
        ))

    def ends(self, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Positions at which the shift is 0, found by stepping through all texts at once."""
        n = np.maximum(np.diff(offsets) - self.run + 1, 0)
        lanes = -(-n // LANE)
        text = np.repeat(np.arange(len(n)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = offsets[:-1][text] + self.run - 1 + nth * LANE
        stop = np.minimum(pos + LANE, offsets[1:][text])
        found = [np.zeros(0, np.int64)]
        while len(pos):
            step = self.shift[(_hash(tokens, pos, self.block) >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
            found.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        return np.concatenate(found)

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item) with a run in common."""
        end = self.ends(w.token, w.offsets)
        key = (_hash(w.token, end, self.suffix) >> np.uint64(32)).astype(np.uint32)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        some = high > low
        end, low, size = end[some], low[some], (high - low)[some]
        met = [np.zeros(0, np.int64)]
        for s in _slices(size):
            nth, row = _expand(low[s], size[s])
            pos = end[s][row] - self.run + 1
            for j in range(self.run):  # compared word by word from the start of the window
                same = w.token[pos + j] == self.token[self.runs[nth] + j]
                nth, pos = nth[same], pos[same]
            at = self.runs[nth]
            last = self.run - 1
            ok = _same_bytes(w.norm, w.start[pos], w.end[pos + last], self.norm, self.start[at], self.end[at + last])
            text = np.searchsorted(w.offsets, pos[ok], side="right") - 1
            met.append(np.unique(text << 32 | self.sets[nth[ok]]))
        both = np.unique(np.concatenate(met))
        text, nth = both >> 32, both & 0xFFFFFFFF
        size = (self.begin[nth + 1] - self.begin[nth]).astype(np.int64)
        pairs = [np.zeros(0, np.int64)]
        for s in _slices(size):
            at, row = _expand(self.begin[nth[s]].astype(np.int64), size[s])
            pairs.append(np.unique(text[s][row] << 32 | self.members[at]))
        both = np.unique(np.concatenate(pairs))
        return both >> 32, self.ids[both & 0xFFFFFFFF]


def _pieces(run: int, piece: int):
    """Items as texts of their words, long ones in pieces that have run - 1 words in common."""

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK_ROWS):
            w = Words(t["text"].to_pylist())
            n = np.diff(w.offsets)
            count = np.where(n >= run, np.maximum(1, -(-(n - run + 1) // piece)), 0)
            nth, row = _expand(np.zeros(len(n), np.int64), count)
            first = w.offsets[:-1][row] + nth * piece
            last = np.minimum(first + piece + run - 1, w.offsets[1:][row]) - 1
            norm = w.norm.tobytes()
            texts = [norm[w.start[a] : w.end[b]].decode() for a, b in zip(first, last)]
            yield pa.RecordBatch.from_arrays([t["item"].combine_chunks().take(pa.array(row)), pa.array(texts, pa.string())], ["item", "piece"])

    return go


def _build(run: int):
    """The index of a partition's pieces as rows ``(name, data)`` of bounded size."""

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("item", pa.int64()), ("piece", pa.string())]))
        if not t.num_rows:
            return
        index = Index.build(t["item"].to_pylist(), t["piece"].to_pylist(), run)
        for name, _ in Index.ARRAYS:
            data = getattr(index, name).tobytes()
            for at in range(0, max(len(data), 1), STORED):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data[at : at + STORED]], pa.binary())], ["name", "data"])

    return go


def _load(path: str, run: int) -> Index:
    parts: dict[str, list[bytes]] = {}
    for batch in pq.ParquetFile(path).iter_batches(batch_size=8):
        for name, data in zip(batch["name"].to_pylist(), batch["data"].to_pylist()):
            parts.setdefault(name, []).append(data)
    return Index(run, {name: np.frombuffer(b"".join(parts.pop(name)), kind) for name, kind in Index.ARRAYS})


def _scan(files: list[str], run: int, held_bytes: int):
    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _load(SparkFiles.get(files[0]), run) if len(files) == 1 else None
        held: list[tuple[pa.Array, Words]] = []

        def searched() -> Iterator[pa.RecordBatch]:
            for f in files:
                index = kept or _load(SparkFiles.get(f), run)
                for doc, w in held:
                    text, item = index.search(w)
                    yield pa.RecordBatch.from_arrays([doc.take(pa.array(text)), pa.array(item)], ["doc", "item"])
                del index
            held.clear()

        for t in chunks(batches, CHUNK_ROWS):
            held.append((t["doc"].combine_chunks(), Words(t["text"].to_pylist())))
            if kept or sum(w.norm.nbytes + 2 * w.token.nbytes for _, w in held) > held_bytes:
                yield from searched()
        yield from searched()

    return go


def leaks(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", run: int = RUN,
    index_bytes: int = INDEX_BYTES, piece: int = PIECE, held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """``(doc, item)``: the documents that have ``run`` consecutive words in common
    with an item. Words are runs of a-z and 0-9 of the lower-cased text.

    The items are cut into pieces and dealt into parts of about ``index_bytes`` of text; tasks
    build the index of each part and write it to the shared folder, from where every executor
    gets the files. Nothing of them passes through the driver. The corpus is read
    once: a task makes the words of some documents and searches them for one part after
    the other, so it holds one part at a time. Null and shorter texts leak nothing,
    nor do rows without an id; repeated rows are indexed once and give one pair; empty tables give none.
    """
    spark = documents.sparkSession
    t = documents.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null and text is not null")
    every = items.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    parts, _ = write_table(every.mapInArrow(_pieces(run, piece), "item long, piece string").distinct(), "pieces")
    total = parts.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    path = scratch_path(spark, "index")
    parts.repartition(-(-total // index_bytes) or 1, "item", "piece").mapInArrow(_build(run), "name string, data binary").write.option("compression", "lz4").parquet(path)
    drop_at_end(spark, path)
    files = [f for f, _ in files_at(spark, path) if f.endswith(".parquet")] if total else []
    if not files:
        return t.select(F.col("doc").alias(doc), F.col("doc").alias(item)).limit(0)
    for f in files:
        spark.sparkContext.addFile(f)
    found = t.mapInArrow(_scan([f.rsplit("/", 1)[1] for f in files], run, held_bytes), "doc long, item long")
    return found.distinct().select(F.col("doc").alias(doc), F.col("item").alias(item))
