"""Session settings and tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, app: str = "strandloom") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: what ``spark.checkpoint.dir`` names, else the
    checkpoint folder that the session was given in code.

    Only a local session with neither gets a folder of its own; a cluster session
    is refused then, because a machine-local folder would be lost with the machine.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandloom-"))
    return sc.getCheckpointDir().rstrip("/")


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage,
    and a lost executor costs no more than the reading of the files. The folder
    goes when the driver ends, unless ``drop_table`` was there first."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Marks a written folder for deletion when the driver ends."""
    fs, p = _fs_path(spark, path)
    fs.deleteOnExit(p)


def drop_table(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _fs_path(spark, path)
        fs.delete(p, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file so that it is there whole or not at all."""
    fs, p = _fs_path(spark, path)
    _, draft = _fs_path(spark, path + ".draft")
    out = fs.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not fs.rename(draft, p):
        raise OSError(f"cannot write {path}")


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs_path(spark, path)
    got = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(got, "UTF-8")
    finally:
        got.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, none if it does not exist."""
    fs, p = _fs_path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def files_at(spark: SparkSession, paths: str) -> list[tuple[str, int]]:
    """Full addresses and sizes of the files at comma-separated paths or patterns, those in nested
    folders too; hidden ones are left out. Whatever file system the session knows will do."""
    found: list[tuple[str, int]] = []
    for path in paths.split(","):
        fs, p = _fs_path(spark, path)
        at = fs.globStatus(p)
        if not at:
            raise FileNotFoundError(path)
        todo = list(at)
        while todo:
            x = todo.pop()
            name = x.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if x.isDirectory():
                todo += list(fs.listStatus(x.getPath()))
            else:
                found.append((x.getPath().toString(), x.getLen()))
    return sorted(found)
