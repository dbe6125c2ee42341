"""Occurrences and record counts of every distinct item, kept by signed deltas in a persistent, partitioned store.

The store is a folder with the entries of each record as last counted (in record buckets), the counts of each item (in
item buckets) and manifests. ``apply`` takes a batch of added, changed and deleted records, turns only those into signed
changes (what a record held before counts minus, what it holds now plus), adds the changes up, and reads only the buckets
of either kind that they touch: of counts these are rewritten, beside the records of a bucket the changed ones are laid
down with the batch's version. New files count once a manifest of the next version names them, counts and records
together: a batch that failed half-way has changed nothing and can be given again. A store is opened again, by any
session, from its folder.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import delete, names_in, read_text, work_area, write_new_text

SPACE = " \t\n\x0b\f\r"

ENTRY = "array<struct<source_field:string,item:string,count:bigint>>"
HELD = f"record_key string, entries {ENTRY}, version bigint"
COUNTS = "source_field string, item string, occurrences bigint, records bigint"
#: Bytes of a batch, as written, a bucket is made for; a batch that fills buckets this many times over makes more of them.
BUCKET_BYTES, GROWTH = 4_000_000, 4
#: Batches whose records may lie beside each other in a record bucket before they are made into one.
BESIDE = 8
MANIFEST = re.compile(r"manifest-(\d+)\.json")


def cleaned(field: str, items: Column, text: str, lower: bool) -> Column:
    """The entries of one list column that count (text not null, count positive), with texts trimmed."""
    ok = F.filter(F.coalesce(items, F.array()), lambda x: x.isNotNull() & x[text].isNotNull() & (x["count"] > 0))
    trim = lambda x: F.btrim(F.lower(x[text]) if lower else x[text], F.lit(SPACE))
    return F.transform(ok, lambda x: F.struct(F.lit(field).alias("source_field"), trim(x).alias("item"), x["count"].cast("bigint").alias("count")))


class TermCounts:
    """Counts of items over a collection of records; ``records`` is the number of records now held.

    ``folder`` holds the store; one that exists is opened at its newest version. There may be one writer at a time: of two
    that write the same version the second gets a FileExistsError.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder
        self.version, self.records, self.buckets = 0, 0, buckets or 0
        # bucket -> folders of its rows: one of counts, up to BESIDE of records
        self.counted: dict[int, list[str]] = {}
        self.held: dict[int, list[str]] = {}
        known = [int(m[1]) for n in names_in(spark, folder) if (m := MANIFEST.fullmatch(n))]
        if known:
            m = json.loads(read_text(spark, f"{folder}/manifest-{max(known)}.json"))
            self.version, self.records, self.buckets = m["version"], m["records"], m["buckets"]
            self.counted, self.held = [{int(b): at for b, at in m[k].items()} for k in ("counted", "held")]

    def _read(self, parts: dict[int, list[str]], buckets: list[int], schema: str) -> DataFrame:
        paths = sorted(f"{self.folder}/{p}" for b in buckets for p in parts.get(b, []))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, touched: list[int], parts: dict[int, list[str]]) -> dict[int, list[str]]:
        """Write rows (with ``bucket``) as the new contents of the touched buckets, beside those of others; where all lie."""
        name = f"{name}-{uuid.uuid4().hex[:8]}"  # another writer of the same version writes elsewhere
        rows.repartition(self.buckets, "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        there = {int(n.split("=", 1)[1]): f"{name}/{n}" for n in names_in(self.spark, f"{self.folder}/{name}") if n.startswith("bucket=")}
        kept = {b: at for b, at in parts.items() if b not in touched}
        return kept | {b: [*kept.get(b, []), at] for b, at in there.items()}

    def _bucket(self, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(self.buckets)).cast("int").alias("bucket")

    def _changes(self, entries: DataFrame) -> DataFrame:
        """entries(sign, sorted entries) -> (source_field, item, occurrences, records); an item twice in a record is one record."""
        x = F.col("entries")
        shifted = F.concat(F.array(F.lit(None).cast("struct<source_field:string,item:string,count:bigint>")), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
        # each entry beside the one before it: the list itself is not carried along with every entry
        e = entries.where(F.size(x) > 0).select("sign", F.explode(F.arrays_zip(x.alias("x"), shifted.alias("y"))).alias("z")).select("sign", "z.x", "z.y")
        same = (F.col("y.source_field") == F.col("x.source_field")) & (F.col("y.item") == F.col("x.item"))
        e = e.select("x.source_field", "x.item", (F.col("sign") * F.col("x.count")).alias("c"), F.when(F.coalesce(same, F.lit(False)), 0).otherwise(F.col("sign")).alias("r"))
        return e.groupBy("source_field", "item").agg(F.sum("c").alias("occurrences"), F.sum("r").cast("bigint").alias("records"))

    def apply(self, batch: DataFrame, written: int | None = None) -> None:
        """batch(record_key STRING, entries, deleted BOOLEAN), one row per added, changed or deleted record.

        A record whose entries did not change causes no delta; deleting an unknown record does nothing; a null key is no
        record. A record has one row in a batch. A batch that changes nothing leaves the store as it is. ``written`` says
        that the batch is read from a table that stays as it is, of so many bytes, with sorted entries; any other batch is
        written first, as it is read more than once.
        """
        area = work_area(self.spark, "terms")
        turn = self.version + 1
        new = batch.where("record_key IS NOT NULL").select("record_key", F.when(F.col("deleted"), None).otherwise(F.col("entries") if written is not None else F.sort_array("entries")).alias("now"))
        if written is None:
            new = area.put(new, "batch")
        wanted = -(-(area.bytes("batch") if written is None else written) // BUCKET_BYTES)
        counted, held, was, before = self.counted, self.held, self.held, self.buckets
        self.buckets = self.buckets or max(4, wanted)
        everything = wanted > GROWTH * self.buckets
        if everything:  # more buckets: all of them are written anew
            self.buckets, counted, held = wanted, {}, {}
        if was:
            touched = [r[0] for r in new.select(self._bucket("record_key")).distinct().collect()] if not everything else list(was)
            old = self._read(was, touched, HELD).join(new.select("record_key"), "record_key", "left_semi")
            both = new.join(_newest(old).withColumnRenamed("entries", "was"), "record_key", "left")
            both = area.put(both, "both")
        else:
            both = new.withColumn("was", F.lit(None).cast(ENTRY))
        changed = both.where("NOT (was <=> now)")
        came = changed.agg(F.count("*"), F.count_if(F.col("was").isNull()), F.count_if(F.col("now").isNull())).first()
        if not came[0]:
            area.close()
            self.buckets = before
            return
        signed = changed.where("now IS NOT NULL").select(F.lit(1).alias("sign"), F.col("now").alias("entries"))
        if was:
            signed = signed.unionByName(changed.where("was IS NOT NULL").select(F.lit(-1).alias("sign"), F.col("was").alias("entries")))
        delta = self._changes(signed).where("occurrences <> 0 OR records <> 0")
        if was:
            delta = area.put(delta.withColumn("bucket", self._bucket("source_field", "item")), "delta")
            dirty = list(range(self.buckets)) if everything else [r[0] for r in delta.select("bucket").distinct().collect()]
            old = self.counts() if everything else self._read(self.counted, dirty, COUNTS)
            delta = old.unionByName(delta.drop("bucket")).groupBy("source_field", "item").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("records > 0")
        else:
            dirty = list(range(self.buckets))
        counted = self._write(delta.withColumn("bucket", self._bucket("source_field", "item")), f"counts-{turn}", dirty, counted)
        fresh = changed.select("record_key", F.col("now").alias("entries"), F.lit(turn).cast("bigint").alias("version"))
        bucket = self._bucket("record_key")
        if everything:
            whole = _newest(self._read(was, list(was), HELD).unionByName(fresh)).where("entries IS NOT NULL").withColumn("version", F.lit(turn).cast("bigint"))
            held = self._write(whole.withColumn("bucket", bucket), f"held-{turn}", list(range(self.buckets)), held)
        else:
            crowded = [b for b, at in was.items() if len(at) >= BESIDE]
            rows = fresh if was else fresh.where("entries IS NOT NULL")
            if crowded:
                again = self._read(was, crowded, HELD).unionByName(fresh.where(bucket.isin(crowded)))
                rows = fresh.where(~bucket.isin(crowded)).unionByName(_newest(again).where("entries IS NOT NULL").withColumn("version", F.lit(turn).cast("bigint")))
            held = self._write(rows.withColumn("bucket", bucket), f"held-{turn}", crowded, held)
        records = self.records + came[1] - came[2]
        manifest = {"version": turn, "records": records, "buckets": self.buckets, "counted": counted, "held": held}
        write_new_text(self.spark, f"{self.folder}/manifest-{turn}.json", json.dumps(manifest))
        self.version, self.records, self.counted, self.held = turn, records, counted, held
        area.close()

    def vacuum(self) -> None:
        """Delete buckets and manifests of older versions, which readers of this version do not need."""
        live = {p for parts in (self.counted, self.held) for at in parts.values() for p in at}
        for n in names_in(self.spark, self.folder):
            m = MANIFEST.fullmatch(n)
            if m and int(m[1]) < self.version:
                delete(self.spark, f"{self.folder}/{n}")
            elif not m and not n.endswith(".json"):
                for part in names_in(self.spark, f"{self.folder}/{n}"):
                    if part.startswith("bucket=") and f"{n}/{part}" not in live:
                        delete(self.spark, f"{self.folder}/{n}/{part}")

    def counts(self) -> DataFrame:
        """(source_field, item, occurrences, records) of every item held."""
        return self._read(self.counted, list(self.counted), COUNTS)

    def marked(self, min_records: int = 3, min_occurrences: int = 10, max_share: float = 0.2) -> DataFrame:
        """``counts`` with marks: array of ``rare`` (few records or occurrences) and ``common`` (in more than a share of all records)."""
        rare = (F.col("records") < min_records) | (F.col("occurrences") < min_occurrences)
        common = F.col("records") > F.lit(max_share) * F.lit(self.records)
        return self.counts().withColumn("marks", F.filter(F.array(F.when(rare, F.lit("rare")), F.when(common, F.lit("common"))), lambda m: m.isNotNull()))


def _newest(rows: DataFrame) -> DataFrame:
    """(record_key, entries) of the newest version of each record; null entries: deleted."""
    return rows.groupBy("record_key").agg(F.max_by("entries", "version").alias("entries"))


def vocabulary_batches(vocabularies: DataFrame) -> tuple[list[DataFrame], int]:
    """The table as two batches, each record's first build, then the current one of those built again; and the bytes of
    the table they are read from."""
    key = F.concat_ws("\x00", "repo_id", "package")
    v = vocabularies.where("repo_id IS NOT NULL AND package IS NOT NULL").select(key.alias("record_key"), F.struct("built_at", "identifiers", "terms").alias("build"))
    builds = v.groupBy("record_key").agg(F.min("build").alias("first"), F.max("build").alias("last"))
    entries = lambda b: F.sort_array(F.concat(cleaned("identifier", F.col(f"{b}.identifiers"), "text", False), cleaned("term", F.col(f"{b}.terms"), "term", True)).cast(ENTRY))
    area = work_area(vocabularies.sparkSession, "builds")
    again = F.when(~F.col("last").eqNullSafe(F.col("first")), entries("last"))
    builds = area.put(builds.select("record_key", entries("first").alias("first"), again.alias("last")), "builds")
    return [builds.where(f"{b} IS NOT NULL").select("record_key", F.col(b).alias("entries"), F.lit(False).alias("deleted")) for b in ("first", "last")], area.bytes("builds")


def vocabulary_counts(vocabularies: DataFrame, folder: str | None = None) -> TermCounts:
    """Counts of all terms and identifiers over current rows: first builds are loaded, then only records built again come
    in as changes. A new store in ``folder``, or in the work area, if none is given."""
    spark = vocabularies.sparkSession
    state = TermCounts(spark, folder or work_area(spark, "counts").root)
    batches, size = vocabulary_batches(vocabularies)
    for batch in batches:
        state.apply(batch, size)
    return state
