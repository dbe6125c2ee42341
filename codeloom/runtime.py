"""Session defaults and the shared work area in which long lineages are cut."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def session(app: str = "codeloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win over these."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


_OWN: dict[str, str] = {}
_OPEN: list[WorkArea] = []


def free_all() -> None:
    """Remove the intermediate tables of all work areas; results that still read them must have been written before."""
    while _OPEN:
        _OPEN.pop().close()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where that is unset a temporary one, if all runs in one
    process on this machine (tests); on a cluster such a folder would be another one on each machine, which is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        at = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="codeloom-")
        _OWN[app] = at
    return at.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears whole under its name or not at all; an existing one of that name is an error."""
    fs, p = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(p) or not fs.rename(draft, p):
        fs.delete(draft, False)
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def file_token(spark: SparkSession, *paths: str) -> tuple:
    """Names, lengths and times of the files at or below some paths: another token when any of them changed."""
    out = []
    for path in paths:
        fs, p = _fs(spark, path)
        found = fs.listFiles(p, True)
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


class WorkArea:
    """Named intermediate tables under the shared folder.

    ``put`` writes a DataFrame and returns the written table, so that its lineage ends in replicated files and a lost
    executor costs no recomputation of earlier steps. ``drop`` removes a table that nothing reads any more; the rest goes
    when the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str, kept: bool = False):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if kept:  # stays until the interpreter ends, whatever free_all removes
            atexit.register(self.close)
            return
        if not _OPEN:
            atexit.register(free_all)
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*by) if by else w).parquet(self.path(name))
        # the schema is given, so that a table without rows can be read; partition columns come last
        fields = [f for f in df.schema.fields if f.name not in (by or [])] + [df.schema[c] for c in by or []]
        return self.get(name, StructType(fields))

    def get(self, name: str, schema=None) -> DataFrame:
        r = self.spark.read
        return (r.schema(schema) if schema is not None else r).parquet(self.path(name))

    def read(self, names: list[str], schema) -> DataFrame:
        """The rows of those of the named folders that exist."""
        there = [self.path(n) for n in names if (lambda fs, p: fs.exists(p))(*_fs(self.spark, self.path(n)))]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def parts(self, name: str) -> list[str]:
        """The partition values of a table written with one partition column."""
        fs, p = _fs(self.spark, self.path(name))
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n.split("=", 1)[1] for n in names if "=" in n)

    def bytes(self, name: str) -> int:
        fs, p = _fs(self.spark, self.path(name))
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def drop(self, *names: str) -> None:
        for n in names:
            fs, p = _fs(self.spark, self.path(n))
            fs.delete(p, True)

    def close(self) -> None:
        try:
            if self.spark._jsc.sc().isStopped():
                raise RuntimeError
            fs, p = _fs(self.spark, self.root)
            fs.delete(p, True)
        except Exception:  # the JVM may already be gone; a local folder can still be removed
            if self.root.startswith("file:"):
                import shutil

                shutil.rmtree(self.root[len("file:") :].replace("//", "/", 1), ignore_errors=True)


def work_area(spark: SparkSession, name: str) -> WorkArea:
    return WorkArea(spark, name)


def driver_tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(os.path.join(folder, f"{n}.parquet")) for n in names]
