"""How often every term of fixed length occurs, kept up to date by signed deltas."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.vectors import chunks, codes, flat, windows
from strandloom.session import drop_at_end, drop_table, get_text, names_in, put_text, scratch_path, write_table

#: Records that a task combines at once: their number takes 15 bits.
CHUNK_ROWS = 1 << 15
#: Partitions of the counts at least; else as many as the session's shuffles have.
BUCKETS = 24
#: Deltas are merged into the base once they hold more than this share of its rows.
COMPACT = 0.5
COUNTS = "term long, n_total long, n_records long"


def _terms(t: pa.Table, names: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """All terms of the texts of a chunk and their rows."""
    term, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for name in names:
        data, offsets = flat(t[name])
        start, at = windows(data, offsets, k)
        term.append(codes(data, start, k))
        row.append(at)
    return np.concatenate(term), np.concatenate(row)


def _by_term(term: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """In the order of term, then row; both share one number where it holds them."""
    if 2 * k + 15 > 63:
        order = np.lexsort((row, term))
        return term[order], row[order]
    both = np.sort(term << 15 | row)
    return both >> 15, both & (CHUNK_ROWS - 1)


def _deltas(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK_ROWS):
            sign = t["sign"].to_numpy().astype(np.int64)
            term, rec = _by_term(*_terms(t, t.column_names[:-1], k), k)
            if not len(term):
                continue
            new_term = np.concatenate([[True], term[1:] != term[:-1]])
            first = new_term | np.concatenate([[True], rec[1:] != rec[:-1]])
            at = np.flatnonzero(new_term)
            s = sign[rec]
            total, held = np.add.reduceat(s, at), np.add.reduceat(s * first, at)
            yield pa.RecordBatch.from_arrays([pa.array(term[at]), pa.array(total), pa.array(held)], ["term", "n_total", "n_records"])

    return run


def _each(k: int):
    """``(id, sign, term, n)`` of single texts ``(id, sign, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK_ROWS):
            term, row = _by_term(*_terms(t, ["text"], k), k)
            at = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])])) if len(term) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([at, [len(term)]]))
            here = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [t["id"].combine_chunks().take(here), t["sign"].combine_chunks().take(here), pa.array(term[at]), pa.array(n)], ["id", "sign", "term", "n"]
            )

    return run


def deltas(signed: DataFrame, fields: list[str], k: int) -> tuple[DataFrame, str]:
    """Changes ``(term, n_total, n_records)`` that signed rows ``(id, *fields, sign)`` make to
    the counts, and the folder of the records that they are read from; rows of one id and sign are
    one record, the set of their texts by field.

    Records of one content are combined a chunk at a time before the shuffle. Those of
    several go text by text, and count a term once through their id: however many
    rows an id has, they are not gathered.
    """
    content = F.struct(*fields)
    heads = signed.groupBy("id", "sign").agg(F.min(content).alias("lo"), F.max(content).alias("hi"))
    heads, path = write_table(heads.select("id", "sign", "lo.*", (~F.col("lo").eqNullSafe(F.col("hi"))).alias("several")), "heads")
    one = heads.where("not several").select(*fields, "sign").mapInArrow(_deltas(k), COUNTS)
    several = heads.where("several").select("id", "sign")
    if several.isEmpty():
        return one, path
    rows = signed.join(several, ["id", "sign"], "left_semi")
    texts = rows.select("id", "sign", F.posexplode(F.array(*fields)).alias("field", "text")).where("text is not null").distinct()
    each = texts.select("id", "sign", "text").mapInArrow(_each(k), "id string, sign int, term long, n long")
    held = each.groupBy("id", "sign", "term").agg(F.sum("n").alias("n"))
    return one.unionByName(held.select("term", (F.col("n") * F.col("sign")).alias("n_total"), F.col("sign").cast("long").alias("n_records"))), path


def _summed(t: DataFrame) -> DataFrame:
    sums = t.groupBy("term").agg(F.sum("n_total").alias("n_total"), F.sum("n_records").alias("n_records"))
    return sums.where("n_total != 0 or n_records != 0")


def decode(term: Column, k: int) -> Column:
    """The letters of a coded term."""
    digits = F.lpad(F.conv(term.cast("string"), 10, 4), k, "0")
    return F.translate(digits, "0123", "ACGT")


class TermCounts:
    """Counts of all terms of k <= 31 bases over a collection of records, kept in a folder
    that all executors share; a store that lies at ``path`` is opened again with all it held.

    A record is an id with the set of its distinct texts by field: several rows of an id
    are one record, a null text adds nothing. A term occurs at each position from which
    k letters A, C, G, T run; null, empty and shorter texts hold none; a repeated term counts
    once for its record. Rows with a null id are left out. An empty collection has no counts.

    ``apply`` takes the records added or changed and the ids deleted; ``apply_snapshot`` finds
    them in the new state of the collection. Only they are turned into signed changes of
    terms, which are added as a batch to the table that holds the base, in the same buckets (by
    the hash of the term), so that reading sums base and deltas without a shuffle. When deltas
    exceed ``compact`` of the base they are merged into a new one. The records lie in a log of
    the same kind. A manifest names the batches that count: a run that breaks off leaves the
    last state. One writer at a time.
    """

    def __init__(
        self, spark: SparkSession, k: int = 21, fields: tuple[str, ...] = ("read_f", "read_r"), key: str = "id", buckets: int | None = None,
        path: str | None = None, compact: float = COMPACT,
    ):
        if not 1 <= k <= 31:
            raise ValueError("k must be between 1 and 31")
        self.spark, self.key, self.fields, self.compact = spark, key, list(fields), compact
        self.kept = bool(path)
        self.path = (path or scratch_path(spark, "terms")).rstrip("/")
        self.tag = hashlib.sha256(self.path.encode()).hexdigest()[:16]
        held = [n for n in names_in(spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        if held:
            self.state = json.loads(get_text(spark, f"{self.path}/{held[-1]}"))
            if (self.state["k"], self.state["fields"]) != (k, self.fields):
                raise ValueError(f"the store at {self.path} holds terms of {self.state['k']} letters of {self.state['fields']}")
            self.buckets = self.state["buckets"]
            self._declare(self.state["table"])
        else:
            buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
            self.state = {"k": k, "fields": self.fields, "buckets": buckets, "version": 0, "records": 0, "table": "", "counts": {}, "log": {}}
        self.k, self.buckets = k, self.state["buckets"]

    # tables

    def _table(self, name: str) -> str:
        return f"spark_catalog.default.strandloom_terms_{self.tag}_{name}"

    def _declare(self, name: str) -> None:
        if name:
            self.spark.sql(
                f"create table if not exists {self._table(name)} (term bigint, n_total bigint, n_records bigint, batch string) using parquet "
                f"options (path '{self.path}/{name}') clustered by (term) into {self.buckets} buckets"
            )

    def _write_counts(self, state: dict, df: DataFrame) -> None:
        """Sums of ``df`` as a batch of the table that ``state`` names, or of a new one."""
        batch = uuid.uuid4().hex
        state["table"] = state["table"] or f"c{batch}"
        seen = Observation()
        dealt = _summed(df.repartition(self.buckets, "term")).observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("batch", F.lit(batch))
        w = dealt.write.format("parquet").mode("append").bucketBy(self.buckets, "term").option("path", f"{self.path}/{state['table']}")
        w.saveAsTable(self._table(state["table"]))
        state["counts"][batch] = seen.get["rows"]

    def _batches(self, table: str, batches: Iterable[str]) -> DataFrame:
        return self.spark.table(self._table(table)).where(F.col("batch").isin(list(batches)))

    def _log(self) -> DataFrame | None:
        """Rows ``(id, *fields, gone, version)`` of all versions."""
        if not self.state["log"]:
            return None
        return self._read_log(self.state["log"])

    def _read_log(self, names: Iterable[str]) -> DataFrame:
        schema = "id string, " + ", ".join(f"f{i} string" for i in range(len(self.fields))) + ", gone boolean, version int"
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names))

    def records(self) -> DataFrame:
        """The records held: distinct rows ``(id, *fields)``."""
        rows = self._latest(self._log())
        return rows.select("id", *(F.col(f"f{i}").alias(c) for i, c in enumerate(self.fields)))

    def _latest(self, log: DataFrame | None) -> DataFrame:
        if log is None:
            return self.spark.createDataFrame([], "id string, " + ", ".join(f"f{i} string" for i in range(len(self.fields))))
        if len(self.state["log"]) > 1:
            last = log.groupBy("id").agg(F.max("version").alias("version"))
            log = log.join(last, ["id", "version"], "left_semi")
        return log.where("not gone").drop("gone", "version")

    # changes

    def _rows(self, df: DataFrame) -> DataFrame:
        t = df.select(F.col(self.key).cast("string").alias("id"), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(self.fields)))
        return t.where("id is not null").distinct()

    def apply(self, changed: DataFrame, deleted: DataFrame | None = None) -> TermCounts:
        """``changed`` has all rows of each record that is new or not as before, ``deleted`` the
        ids of those that are no more (ids that are not held are passed over; one in both stays)."""
        return self._apply(self._rows(changed), deleted.select(F.col(self.key).cast("string").alias("id")) if deleted is not None else None)

    def _apply(self, rows: DataFrame, deleted: DataFrame | None) -> TermCounts:
        state = json.loads(json.dumps(self.state))
        state["version"] += 1
        log = f"r{uuid.uuid4().hex}"
        fields = [f"f{i}" for i in range(len(self.fields))]
        new = rows.withColumn("gone", F.lit(False))
        if deleted is not None:
            gone = deleted.where("id is not null").distinct().join(rows.select("id"), "id", "left_anti")
            new = new.unionByName(gone.select("id", *(F.lit(None).cast("string").alias(f) for f in fields), F.lit(True).alias("gone")))
        new.withColumn("version", F.lit(state["version"])).write.parquet(f"{self.path}/{log}")
        if not self.kept:
            drop_at_end(self.spark, self.path)
        new = self._read_log([log])
        signed = new.where("not gone").select("id", *fields, F.lit(1).alias("sign"))
        state["records"] += signed.select("id").distinct().count()
        scratch = None
        if state["log"]:
            before = self._latest(self._log().join(new.select("id").distinct(), "id", "left_semi"))
            before, scratch = write_table(before, "before")
            state["records"] -= before.select("id").distinct().count()
            signed = signed.unionByName(before.select("id", *fields, F.lit(-1).alias("sign")))
        changes, heads = deltas(signed, fields, self.k)
        self._write_counts(state, changes)
        state["log"][log] = new.count()
        drop_table(self.spark, heads, *([scratch] if scratch else []))
        self._commit(state)
        self._compact()
        return self

    def apply_snapshot(self, rows: DataFrame) -> TermCounts:
        """``rows`` is the collection as it is now: what differs from the records held is applied."""
        rows = self._rows(rows)
        if not self.state["log"]:
            return self._apply(rows, None)
        rows, path = write_table(rows, "snapshot")
        sides = rows.withColumn("_side", F.lit(1)).unionByName(self._latest(self._log()).withColumn("_side", F.lit(2)))
        differ = sides.groupBy(*rows.columns).agg(F.bit_or("_side").alias("_side")).where("_side != 3").select("id").distinct()
        ids, ids_path = write_table(differ, "touched")
        self._apply(rows.join(ids, "id", "left_semi"), ids)
        drop_table(self.spark, path, ids_path)
        return self

    def _commit(self, state: dict) -> None:
        put_text(self.spark, f"{self.path}/manifest-{state['version']:09}.json", json.dumps(state))
        self.state = state
        for name in names_in(self.spark, self.path):
            manifest = name.startswith("manifest-") and name != f"manifest-{state['version']:09}.json"
            if manifest or name[0] in "cr" and name != state["table"] and name not in state["log"]:
                self._forget(name)  # of an earlier state, or of a run that broke off

    def _forget(self, name: str) -> None:
        if name.startswith("c"):
            self.spark.sql(f"drop table if exists {self._table(name)}")
        drop_table(self.spark, f"{self.path}/{name}")

    def _compact(self) -> None:
        state = json.loads(json.dumps(self.state))
        over = {kind: len(n) > 1 and sum(n[1:]) > self.compact * n[0] for kind in ("counts", "log") for n in [list(state[kind].values())]}
        if not any(over.values()):
            return
        state["version"] += 1
        if over["counts"]:
            state["table"], state["counts"] = "", {}
            self._write_counts(state, self._sums())
        if over["log"]:
            name = f"r{uuid.uuid4().hex}"
            self._latest(self._log()).withColumns({"gone": F.lit(False), "version": F.lit(state["version"])}).write.parquet(f"{self.path}/{name}")
            state["log"] = {name: self._read_log([name]).count()}
        self._commit(state)

    def close(self) -> None:
        """Takes the store's table out of the session's catalog; the files stay."""
        if self.state["table"]:
            self.spark.sql(f"drop table if exists {self._table(self.state['table'])}")

    # results

    def _sums(self) -> DataFrame:
        """``(term, n_total, n_records)`` of base and deltas: the deltas are summed and merged into the base,
        bucket by bucket."""
        if not self.state["counts"]:
            return self.spark.createDataFrame([], COUNTS)
        base, *more = self.state["counts"]
        held = self._batches(self.state["table"], [base]).drop("batch")
        if not more:
            return held
        change = _summed(self._batches(self.state["table"], more)).select("term", F.col("n_total").alias("_t"), F.col("n_records").alias("_r"))
        none = F.lit(0).cast("long")
        both = held.join(change.hint("merge"), "term", "full").select(
            "term", *((F.coalesce(c, none) + F.coalesce(d, none)).alias(c) for c, d in (("n_total", "_t"), ("n_records", "_r")))
        )
        return both.where("n_total != 0 or n_records != 0")

    def counts(self) -> DataFrame:
        """``(term, n_total, n_records, mark)`` with the term coded."""
        t = self._sums()
        n = self.state["records"]
        mark = F.when(F.col("n_records") * 100 >= n, "common").when(F.col("n_records") < 4, "rare").otherwise("useful")
        return t.withColumn("mark", mark)

    def spelled(self, t: DataFrame) -> DataFrame:
        return t.withColumn("term", decode(F.col("term"), self.k))


def deliveries(df: DataFrame, at: str, key: str, share: float = 0.9) -> list[DataFrame]:
    """The rows that had arrived when about ``share`` of the table had, and then all rows of the
    records that later ones belong to. Rows without a time of arrival come last."""
    cut = df.agg(F.percentile_approx(at, share)).first()[0]
    early = F.coalesce(F.col(at) <= F.lit(cut), F.lit(False))
    return [df.where(early), df.join(df.where(~early).select(key).distinct(), key, "left_semi")]
