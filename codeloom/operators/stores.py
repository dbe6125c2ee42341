"""Tables of rows by key that are changed in place: inserts, upserts, deletes and whole groups replaced.

A table is a folder of hash buckets and manifests. A change reads and rewrites only the buckets its keys fall into, as new
files beside the old ones; the next manifest names them all at once, so readers see a change whole or not at all, and a
change that failed can be given again. Runs, tool calls, feedback, memories, decisions, facts, fix patterns, processes,
clusters and file hashes are all kept so.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.operators.current import latest
from codeloom.runtime import delete, names_in, read_text, write_new_text

MANIFEST = re.compile(r"manifest-(\d+)\.json")


class KeyedTable:
    """``keys`` tell rows apart, ``by`` (some of the keys, or all) the bucket; ``buckets`` counts for a new table only.

    Null keys are no rows. There may be one writer at a time: of two that write the same version the second gets a
    FileExistsError. ``batch`` is the greatest number given with a change, for sources that repeat a batch.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], by: list[str] | None = None, buckets: int = 32):
        self.spark, self.folder, self.keys, self.by, self.buckets = spark, folder, keys, by or keys, buckets
        self.version, self.batch, self.schema = 0, -1, None
        self.parts: dict[int, list[str]] = {}
        known = [int(m[1]) for n in names_in(spark, folder) if (m := MANIFEST.fullmatch(n))]
        if known:
            m = json.loads(read_text(spark, f"{folder}/manifest-{max(known)}.json"))
            self.version, self.batch, self.buckets, self.by = m["version"], m["batch"], m["buckets"], m["by"]
            self.schema, self.parts = StructType.fromJson(m["schema"]), {int(b): at for b, at in m["parts"].items()}

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows, or those of some buckets; None before the first change."""
        if self.schema is None:
            return None
        at = [f"{self.folder}/{p}" for b, ps in sorted(self.parts.items()) if buckets is None or b in buckets for p in ps]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.by]), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # a row a bucket at most

    def _commit(self, rows: DataFrame, touched: list[int], batch: int | None, add: bool = False) -> None:
        name = f"rows-{self.version + 1}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("bucket", self._bucket()).repartition(max(1, len(touched)), "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        there = {int(n.split("=", 1)[1]): [f"{name}/{n}"] for n in names_in(self.spark, f"{self.folder}/{name}") if n.startswith("bucket=")}
        parts = dict(self.parts) if add else {b: at for b, at in self.parts.items() if b not in touched}
        for b, at in there.items():
            parts[b] = parts.get(b, []) + at
        batch = self.batch if batch is None else max(batch, self.batch)
        m = {"version": self.version + 1, "batch": batch, "buckets": self.buckets, "by": self.by, "schema": json.loads(rows.schema.json()), "parts": parts}
        write_new_text(self.spark, f"{self.folder}/manifest-{self.version + 1}.json", json.dumps(m))
        self.version, self.batch, self.schema, self.parts = self.version + 1, batch, rows.schema, parts

    def _known(self, rows: DataFrame) -> DataFrame:
        for k in self.keys:
            rows = rows.where(F.col(k).isNotNull())
        return rows.select(*self.schema.names) if self.schema is not None else rows

    def append(self, rows: DataFrame, batch: int | None = None) -> None:
        """Rows beside those that are there, whatever their keys."""
        rows = self._known(rows)
        self._commit(rows, list(range(self.buckets)), batch, add=True)

    def upsert(self, rows: DataFrame, at: str | None = None, batch: int | None = None) -> None:
        """Rows replace those of the same key; of several new ones that with the greatest ``at`` (any one without) counts."""
        rows = self._known(rows)
        fresh = latest(rows, self.keys, at).select(*rows.columns) if at else rows.dropDuplicates(self.keys)
        touched = self._touched(fresh)
        old = self.read(touched)
        whole = fresh if old is None else old.join(fresh.select(*self.keys), self.keys, "left_anti").unionByName(fresh)
        if touched:
            self._commit(whole.select(*rows.columns), touched, batch)

    def delete(self, gone: DataFrame) -> None:
        """gone(some of the keys): rows with these values are removed; only their buckets are rewritten where ``by`` is among them."""
        if self.schema is None:
            return
        on = [k for k in self.keys if k in gone.columns]
        touched = self._touched(gone) if set(self.by) <= set(on) else list(range(self.buckets))
        self._commit(self.read(touched).join(gone.select(*on).distinct(), on, "left_anti"), touched, None)

    def replace(self, rows: DataFrame, groups: DataFrame) -> None:
        """groups(by...): all rows of these groups give way to ``rows``, those of them that belong to the groups."""
        rows = self._known(rows).join(groups.select(*self.by).distinct(), self.by, "left_semi")
        touched = self._touched(groups)
        old = self.read(touched)
        kept = rows if old is None else old.join(groups.select(*self.by).distinct(), self.by, "left_anti").unionByName(rows)
        self._commit(kept.select(*rows.columns), touched, None)

    def vacuum(self) -> None:
        """Delete the files and manifests that the newest version does not name."""
        live = {p for ps in self.parts.values() for p in ps}
        for n in names_in(self.spark, self.folder):
            m = MANIFEST.fullmatch(n)
            if m and int(m[1]) < self.version:
                delete(self.spark, f"{self.folder}/{n}")
            elif n.startswith("rows-"):
                for part in names_in(self.spark, f"{self.folder}/{n}"):
                    if part.startswith("bucket=") and f"{n}/{part}" not in live:
                        delete(self.spark, f"{self.folder}/{n}/{part}")


def hub_artifact(symbol_hubs: DataFrame, package_hubs: DataFrame, symbols: int = 8, packages: int = 6) -> DataFrame:
    """symbol_hubs(repo_id, id, n), package_hubs(repo_id, id, n) -> (repo_id, what, id, n, place): the first of each."""
    def first(d, what, k):
        w = Window.partitionBy("repo_id").orderBy(F.desc("n"), "id")
        return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("repo_id", F.lit(what).alias("what"), "id", "n", "place")

    return first(symbol_hubs, "symbol", symbols).unionByName(first(package_hubs, "package", packages))


def table_statistics(d: DataFrame, key: str) -> DataFrame:
    """(n_rows, n_keys, n_null_keys) of a table in one pass and one small aggregation."""
    n = d.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(key).alias("n_keys"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("n_null_keys"))
