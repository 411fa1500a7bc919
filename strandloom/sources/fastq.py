"""Interleaved FASTQ as a Spark data source with byte-range partitions."""

from __future__ import annotations

import bz2
import gzip
import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.functions.vectors import slices
from strandloom.session import files_at

SCHEMA = "id string, seq_f string, qual_f string, seq_r string, qual_r string"
NAMES = ["id", "seq_f", "qual_f", "seq_r", "qual_r"]
#: Bytes that a task holds at once.
READ_BYTES = 8 << 20


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    packed: bool


#: Schemes under which pyarrow knows what Hadoop calls otherwise (fixed values).
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "file:///" + path[5:].lstrip("/")
    elif "://" not in path:
        path = "file://" + path
    scheme, rest = path.split("://", 1)
    system, at = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return system, at


def _stream(path: str, opener: str):
    """A file to read from and seek in. ``opener`` names a function, as ``package.module:function``,
    that opens an address of a file system that pyarrow does not know."""
    if opener:
        module, name = opener.split(":")
        return getattr(importlib.import_module(module), name)(path)
    system, at = _open(path)
    return system.open_input_file(at)


class _Lines:
    """Whole lines from a byte position on, with the position of each."""

    def __init__(self, stream, at: int):
        self.stream, self.at, self.rest = stream, at, b""

    def block(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and starts and ends of the lines in them; empty at the end of the file."""
        more = self.stream.read(READ_BYTES)
        data = self.rest + more
        if not data:
            self.rest = b""
            return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        d = np.frombuffer(data, np.uint8)
        end = np.flatnonzero(d == 10)
        if not more and (not len(end) or end[-1] != len(d) - 1):
            end = np.append(end, len(d))  # the last line needs no newline
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        self.rest = b"" if not more else data[int(end[-1]) + 1 :] if len(end) else data
        return d, start.astype(np.int64), end.astype(np.int64)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.split = int(options.get("splitSize", 64 << 20))
        self.longest = int(options.get("maxLineLength", 10_000))
        self.files = json.loads(options.get("files", "null"))
        self.opener = options.get("opener", "")
        self.strict = options.get("mode", "FAILFAST").upper() != "DROPMALFORMED"

    def _list(self) -> list[tuple[str, int]]:
        """Files and sizes by pyarrow, where ``read_fastq`` has not listed them."""
        from pyarrow import fs

        found = []
        for path in self.path.split(","):
            system, at = _open(path)
            head = path[: len(path) - len(at)] if path.endswith(at) else ""
            info = system.get_file_info(at)
            files = [info] if info.type == fs.FileType.File else [
                x for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))
            ]
            found += sorted((head + f.path, f.size) for f in files)
        return found

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in self.files if self.files is not None else self._list():
            if path.endswith((".gz", ".bz2")):
                out.append(Split(path, 0, 1 << 62, True))
            else:
                out += [Split(path, a, min(a + self.split, size), False) for a in range(0, size, self.split)]
        return out or [Split("", 0, 0, False)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        with _stream(split.path, self.opener) as f:
            if split.packed:
                yield from self._pairs((gzip if split.path.endswith(".gz") else bz2).open(f), 0, split.end, False)
            else:
                # one byte back: a line that starts at the border belongs to this split
                f.seek(max(0, split.start - 1))
                yield from self._pairs(f, max(0, split.start - 1), split.end, split.start > 0)

    def _pairs(self, stream, at: int, end: int, within: bool) -> Iterator[pa.RecordBatch]:
        lines, held = _Lines(stream, at), None
        synced, skip = False, within
        base = at
        while True:
            before = lines.rest
            d, s, e = lines.block()
            last = len(d) == len(before)  # nothing new came in
            base_here = base
            base += len(d) - len(lines.rest)
            if held is not None:  # lines of a pair that the last block broke off
                old = held
                joined = np.concatenate([old[0], d])
                s, e, d = np.concatenate([old[1], s + len(old[0])]), np.concatenate([old[2], e + len(old[0])]), joined
                base_here -= len(old[0])
                held = None
            if skip and len(s):
                s, e, skip = s[1:], e[1:], False
            cut = e - ((e > s) & (d[np.maximum(e - 1, 0)] == 13)) if len(s) else e
            i = 0
            n = len(s)
            while i < n:
                if not synced:
                    i = self._sync(d, s, cut, i, last)
                    if i < 0:
                        i = n if last else max(0, n - 2)
                        break
                    synced = True
                if base_here + s[i] >= end:
                    return
                whole = (n - i) // 8
                if not whole:
                    break
                k = i + 8 * np.arange(whole)
                k = k[base_here + s[k] < end]
                good = (d[s[k]] == 64) & (d[s[k + 4]] == 64) & (cut[k] > s[k]) & (cut[k + 4] > s[k + 4])
                good &= (cut[k[:, None] + np.arange(8)] - s[k[:, None] + np.arange(8)] <= self.longest).all(1)
                fine = len(k) if good.all() else int(good.argmin())
                if fine:
                    yield self._batch(d, s, cut, k[:fine])
                i = int(k[0]) + 8 * fine
                if fine < len(k):
                    if self.strict:
                        raise ValueError(f"record does not start with '@' or has too long a line, at byte {base_here + int(s[i])}")
                    i, synced = i + 1, False
            if last:
                self._leftover(s, cut, i, n)
                return
            if i < n:
                held = (d[s[i] :], s[i:] - s[i], e[i:] - s[i])
                held = (held[0][: held[2][-1] + 1], held[1], held[2])

    def _leftover(self, s, cut, i: int, n: int) -> None:
        """Lines after the last pair: one mate alone is dropped, a broken record is an error."""
        left = n - i
        while left and cut[i + left - 1] == s[i + left - 1]:
            left -= 1
        if left and left != 4 and self.strict:
            raise ValueError("unexpected end of file")

    @staticmethod
    def _sync(d, s, cut, i: int, last: bool) -> int:
        """The first line from i on that starts with @, ends with /1 and has a + two below."""
        n = len(s)
        k = np.arange(i, max(i, n - 2))
        if not len(k):
            return -1
        size = cut[k] - s[k]
        ok = (size >= 3) & (d[s[k]] == 64) & (d[np.maximum(cut[k] - 1, 0)] == 49) & (d[np.maximum(cut[k] - 2, 0)] == 47)
        ok &= (cut[k + 2] > s[k + 2]) & (d[np.minimum(s[k + 2], len(d) - 1)] == 43)
        return int(k[ok.argmax()]) if ok.any() else -1

    @staticmethod
    def _batch(d, s, cut, k) -> pa.RecordBatch:
        first = (cut[k] - s[k] >= 3) & (d[np.maximum(cut[k] - 1, 0)] == 49) & (d[np.maximum(cut[k] - 2, 0)] == 47)
        cols = [slices(d, s[k] + 1, cut[k] - 2 * first), *(slices(d, s[k + j], cut[k + j]) for j in (1, 3, 5, 7))]
        return pa.RecordBatch.from_arrays(cols, NAMES)


class FastqSource(DataSource):
    """Format ``fastq_pairs``: ``(id, seq_f, qual_f, seq_r, qual_r)`` of interleaved
    pairs; id is the header of mate 1 without ``@`` and ``/1``.

    A split finds the first header of a mate 1 whose second line below starts with
    ``+`` and owns the pairs that start in it, so every pair is read once,
    whatever the split size. Compressed files (.gz, .bz2) are one split each.
    Options: splitSize, maxLineLength (10,000), mode FAILFAST (default) or
    DROPMALFORMED, which looks for the next header instead of failing. A lone mate
    1 at the end is dropped; lengths of bases and qualities may differ. Tasks open the files
    through pyarrow, or through the function that the option ``opener`` names.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    """The pairs at comma-separated paths: files, patterns and folders with all that is nested in
    them, of the session's file systems (a path without a scheme means the default one)."""
    spark.dataSource.register(FastqSource)
    files = json.dumps(files_at(spark, path))
    return spark.read.format("fastq_pairs").options(files=files, **options).load(path)


def record_text() -> Column:
    """The eight lines of a pair ``(id, seq_f, qual_f, seq_r, qual_r)``, without a line end."""
    return F.concat_ws(
        "\n", F.concat(F.lit("@"), F.col("id"), F.lit("/1")), "seq_f", F.lit("+"), "qual_f",
        F.concat(F.lit("@"), F.col("id"), F.lit("/2")), "seq_r", F.lit("+"), "qual_r",
    )


def write_fastq(pairs: DataFrame, path: str, compression: str | None = None) -> None:
    """Pairs ``(id, seq_f, qual_f, seq_r, qual_r)`` as interleaved FASTQ text files."""
    out = pairs.select(record_text().alias("value")).write
    (out.option("compression", compression) if compression else out).text(path)
