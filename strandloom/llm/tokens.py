"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.vectors import chunks

#: Where the vocabulary file of the tokenizer lies; only the driver reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern that splits text before merging, fixed by the vocabulary. White
#: space is what Unicode calls so.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CHUNK_ROWS = 1 << 11
#: Pieces whose ids a task remembers; beyond it starts afresh.
MEMORY = 1 << 18
#: Matrices hold about so many cells; a longer piece than LONG bytes merges all places of its
#: least rank in a round, if the vocabulary allows it (see ``Vocabulary.ordered``).
CELLS, LONG = 1 << 20, 2048
NONE = np.int32(1 << 30)


class Vocabulary:
    """First ids of the 256 bytes and an open hash table from pairs of ids to (rank, merged id).

    ``ordered`` tells that every merge comes after all merges that make its two parts. Then
    a merge of the least rank makes only pairs of later rank, so that the places of
    one rank can be merged in one round, with the ids of merging one by one. A vocabulary without
    this order merges pieces of any length one by one."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(printable, map(chr, printable))) | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        ids = model["vocab"]
        self.first = np.array([ids[shown[b]] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        merged = np.array([ids[a + b] for a, b in merges], np.int32)
        made: dict[int, int] = {}
        for i, to in enumerate(merged.tolist()):
            made[to] = i  # the last merge that makes it
        self.ordered = all(made.get(part, -1) < i for i, p in enumerate(pairs.tolist()) for part in (p >> 32, p & 0xFFFFFFFF))
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        self.to = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(pairs))[::-1]  # of a pair given twice the first rank stays
        slot = self._slot(pairs)
        while len(left):
            at = slot[left]
            free = (self.keys[at] == -1) | (self.keys[at] == pairs[left])
            put, where = left[free], at[free]
            self.keys[where], self.rank[where], self.to[where] = pairs[put], put, merged[put]
            lost = self.keys[at] != pairs[left]
            left = left[lost]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair, rank NONE if they never merge."""
        pair = (a.astype(np.int64) << 32 | b).ravel()
        at = self._slot(pair)
        seen = self.keys[at]
        go = np.flatnonzero((seen != pair) & (seen != -1))
        while len(go):
            at[go] = (at[go] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[go]]
            go = go[(seen != pair[go]) & (seen != -1)]
        hit = self.keys[at] == pair
        return np.where(hit, self.rank[at], NONE).reshape(a.shape), self.to[at].reshape(a.shape)


def _merge_matrix(voc: Vocabulary, x: np.ndarray, length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Merges the rows of a padded matrix of ids until none has a pair left; gives
    (row numbers, ids, lengths) of the rows as they get ready."""
    done, row = [], np.arange(len(x))
    column = np.arange(x.shape[1])
    rank = np.full(x.shape, NONE, np.int32)
    to = np.zeros(x.shape, np.int32)
    if x.shape[1] > 1:
        rank[:, :-1], to[:, :-1] = voc.find(x[:, :-1], x[:, 1:])
    rank[column[None, :] >= length[:, None] - 1] = NONE
    while len(row):
        at = rank.argmin(1)
        live = rank[np.arange(len(row)), at] < NONE
        if not live.all():
            done.append((row[~live], x[~live], length[~live]))
            keep = np.flatnonzero(live)
            width = int(length[keep].max()) if len(keep) else 0
            row, x, length, at = row[keep], x[keep, :width], length[keep], at[keep]
            rank, to, column = rank[keep, :width], to[keep, :width], column[:width]
            if not len(row):
                break
        n = np.arange(len(row))
        new = to[n, at]
        # the merged id stands at `at`; all to the right moves up by one
        behind = column[None, :-1] > at[:, None]
        for m in (x, rank, to):
            m[:, :-1] = np.where(behind, m[:, 1:], m[:, :-1])
        x[n, at] = new
        length = length - 1
        rank[:, -1] = NONE
        has_left = at > 0
        if has_left.any():
            i = n[has_left]
            p = at[has_left]
            rank[i, p - 1], to[i, p - 1] = voc.find(x[i, p - 1], x[i, p])
        has_right = at < length - 1
        rank[n, at] = NONE
        if has_right.any():
            i = n[has_right]
            p = at[has_right]
            rank[i, p], to[i, p] = voc.find(x[i, p], x[i, p + 1])
    return done


def _merge_long(voc: Vocabulary, x: np.ndarray) -> np.ndarray:
    """One long piece: each round merges all places of the least rank, left to right; the
    same as one by one for a vocabulary in order."""
    while len(x) > 1:
        rank, to = voc.find(x[:-1], x[1:])
        best = rank.min()
        if best >= NONE:
            break
        hit = np.flatnonzero(rank == best)
        new_run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        run = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        x[hit] = to[hit]
        x = np.delete(x, hit + 1)
    return x


def encode_pieces(voc: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """The ids of each piece: pieces are padded into matrices by the bucket of their length."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    long = length > (LONG if voc.ordered else length.max(initial=0))
    for i in np.flatnonzero(long):
        out[i] = _merge_long(voc, voc.first[np.frombuffer(pieces[i], np.uint8)])
    order = np.argsort(length, kind="stable")
    order = order[(length[order] > 0) & ~long[order]]
    bucket = np.ceil(2 * np.log2(np.maximum(length[order], 1))).astype(int)
    for b in np.unique(bucket):
        same = order[bucket == b]
        width = int(length[same].max())
        for part in np.array_split(same, max(1, -(-len(same) * width // CELLS))):
            size = length[part]
            x = np.zeros((len(part), width), np.int32)
            inside = np.arange(width)[None, :] < size[:, None]
            x[inside] = voc.first[np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)]
            for rows, ids, n in _merge_matrix(voc, x, size.copy()):
                for r, v, m in zip(rows, ids, n):
                    out[part[r]] = v[:m]
    return out


class _Growing:
    """A vector that is appended to in place."""

    def __init__(self, kind, first=()):
        self.data, self.n = np.zeros(1 << 16, kind), 0
        self.add(np.asarray(first, kind))

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + 2 * len(more), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def _encode(voc: Vocabulary, key: str, key_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PIECES, regex.V1).findall
        known: dict[str, int] = {}
        # the ids of all known pieces in a row; begin has one place more than there are pieces
        pool, begin = _Growing(np.int32), _Growing(np.int64, [0])
        for t in chunks(batches, CHUNK_ROWS):
            texts = [split(x) if x else [] for x in t["text"].to_pylist()]
            if len(known) > MEMORY:
                known, pool, begin = {}, _Growing(np.int32), _Growing(np.int64, [0])
            new = list({p for pieces in texts for p in pieces if p not in known})
            ids = encode_pieces(voc, [p.encode("utf-8", "replace") for p in new])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            begin.add(pool.n + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))
            pool.add(np.concatenate([np.zeros(0, np.int32), *ids]))
            piece = np.fromiter((known[p] for pieces in texts for p in pieces), np.int64)
            start = begin.data[piece]
            n = begin.data[piece + 1] - start
            ends = np.concatenate([[0], np.cumsum(n)])
            flat = pool.data[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])] if len(piece) else pool.data[:0]
            per_text = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
            ids = pa.ListArray.from_arrays(pa.array(ends[per_text].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([t[key].combine_chunks().cast(key_type), ids], [key, "ids"])

    return run


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, ids)`` for every row: the ids of its text, without special tokens, whose
    strings are ordinary text. Null and empty texts have the empty list; repeated
    keys give a row each; texts may have any length. No shuffle; the vocabulary
    (its size is fixed by the file) goes along with the tasks."""
    voc = Vocabulary(vocabulary)
    t = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return t.mapInArrow(_encode(voc, "key", pa.int64()), "key long, ids array<int>").withColumnRenamed("key", key)
