"""Scan store: header and child tables, upsert, delete, history.

Tables are Parquet folders ``<table>/bucket=<hash of the scan id>/version=<write>``. A change writes new
versions of the buckets that it touches, of all tables, and then one manifest: the folders that make up
the store from now on. Readers follow the newest manifest, so they see a change of several tables whole
or not at all; what a broken write has left is never read. Earlier versions stay readable by number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from sitelens.sources.staging import staged, work_dir

BUCKETS, FILES = 64, 4
#: one row a folder; bucket -1 carries the schema of a table
MANIFEST = "table string, bucket int, folder string, schema string, version long"
CHILDREN = ("pages", "forms", "documents", "risks", "exports")
SCANS_DDL = ("scan_id string, created_at string, company_name string, site_url string, final_url string, industry string, "
             "email string, comment string, risk_score int, risk_level string, confidence int, status string, "
             "pdf_path string, executive_summary string, top_risks string, raw_json string")
STATUSES = ("new", "scanned", "needs_review", "approved", "sent", "interested", "rejected", "do_not_contact")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("scan_id"), F.lit(buckets)).cast("int")


class Manifest:
    """Folders of each table by bucket, and the schema of each table, as of a version."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.version = spark, path, 0
        self.folders: dict[str, dict[int, str]] = {}
        self.schemas: dict[str, str] = {}
        try:
            every = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return  # nothing stored yet
        if version is None:
            version = every.agg(F.max("version")).first()[0]
        rows = every.where(F.col("version") == F.lit(version)).collect()  # tables times buckets
        if version is not None and not rows:
            raise ValueError(f"no version {version} in {path}")
        self.version = version or 0
        for r in rows:
            if r.bucket < 0:
                self.schemas[r.table] = r.schema
                self.folders.setdefault(r.table, {})
            else:
                self.folders.setdefault(r.table, {})[r.bucket] = r.folder

    def read(self, name: str, buckets=None) -> DataFrame:
        """A table with its bucket column, or those buckets of it."""
        schema = StructType.fromJson(json.loads(self.schemas[name]))
        some = [f for b, f in sorted(self.folders[name].items()) if buckets is None or b in buckets]
        if not some:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))
        whole = self.spark.read.schema(StructType(list(schema.fields)).add("bucket", IntegerType()).add("version", StringType()))
        return whole.option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/{f}" for f in some)).drop("version")

    def write(self, name: str, df: DataFrame, buckets: int, touched=None, files: int = FILES) -> None:
        """New versions of the touched buckets (None: of all). ``files`` tasks write a bucket, each its
        share of the scans. Nothing is visible before commit()."""
        version = f"{self.version + 1}-{uuid.uuid4().hex[:8]}"
        share = F.pmod(F.xxhash64("scan_id", F.lit("file")), F.lit(files))
        rows = df.withColumns({"bucket": _bucket(buckets), "version": F.lit(version)}).repartition("bucket", share)
        rows.write.mode("append").partitionBy("bucket", "version").parquet(f"{self.path}/{name}")
        kept = {} if touched is None else {b: f for b, f in self.folders.get(name, {}).items() if b not in touched}
        made = self._made(name, version)
        self.folders[name] = kept | {b: f"bucket={b}/version={version}" for b in made}
        self.schemas[name] = df.schema.json()

    def _made(self, name: str, version: str) -> list[int]:
        """Buckets that the write has filled: what its folders hold, at most one value a bucket."""
        schema = "scan_id string, bucket int, version string"
        try:
            done = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [r.bucket for r in done.where(F.col("version") == version).select("bucket").distinct().collect()]

    def commit(self) -> None:
        """One file, one rename: readers see the old state before it and the new one after it. A writer
        that was overtaken fails here and has changed nothing."""
        rows = [(t, -1, "", self.schemas[t]) for t in self.folders] + [(t, b, f, None) for t, fs in self.folders.items() for b, f in fs.items()]
        self.spark.createDataFrame(rows, "table string, bucket int, folder string, schema string").coalesce(1).write.mode(
            "error").parquet(f"{self.path}/manifest/version={self.version + 1}")
        self.version += 1


def write_scan_mart(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS):
    """Write header and child tables, each with a scan_id column, in place of what the store held. Choose
    ``buckets`` so that one holds a few hundred MB and keep it for the life of the store."""
    store = Manifest(next(iter(tables.values())).sparkSession, path)
    store.folders, store.schemas = {}, {}
    for name, df in tables.items():
        store.write(name, df, buckets)
    store.commit()


def read_table(spark: SparkSession, path: str, name: str = "scans", version: int | None = None) -> DataFrame:
    """A table as of the newest commit, or of an earlier version."""
    return Manifest(spark, path, version).read(name)


def upsert(old: DataFrame, new: DataFrame, key: str = "scan_id") -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, then all rows of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def _ids(df: DataFrame, buckets: int) -> tuple[DataFrame, set[int]]:
    """Distinct scan ids, and the buckets they lie in: at most ``buckets`` numbers."""
    ids = staged(df.select("scan_id").distinct(), work_dir(df.sparkSession), "ids")
    return ids, {r[0] for r in ids.select(_bucket(buckets)).distinct().collect()}


def upsert_scans(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS):
    """Replace every row of the given scans in all given tables, in one commit; other buckets are not
    rewritten. A table without new rows still loses the old rows of these scans."""
    spark = tables["scans"].sparkSession
    store = Manifest(spark, path)
    ids, touched = _ids(tables["scans"], buckets)
    for name, new in tables.items():
        if name in store.folders:
            kept = store.read(name, touched).drop("bucket").join(ids, "scan_id", "left_anti")
            new = kept.unionByName(new, allowMissingColumns=True)
        store.write(name, new, buckets, touched)
    store.commit()


def delete_scans(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    return {n: df.join(ids.select("scan_id").distinct(), "scan_id", "left_anti") for n, df in tables.items()}


def delete_scans_in(spark: SparkSession, path: str, ids: DataFrame, names=("scans",) + CHILDREN, buckets: int = BUCKETS):
    """Remove scans from the stored tables, in one commit; only the buckets that hold them are rewritten."""
    store = Manifest(spark, path)
    gone, touched = _ids(ids, buckets)
    for n in names:
        if n in store.folders:
            store.write(n, store.read(n, touched).drop("bucket").join(gone, "scan_id", "left_anti"), buckets, touched)
    store.commit()


def unreferenced(spark: SparkSession, path: str) -> DataFrame:
    """Data files (path) that the newest version does not use: left by broken writes or replaced since.
    Whoever keeps no earlier version may delete them."""
    store = Manifest(spark, path)
    used = spark.createDataFrame([(f"/{t}/{f}/",) for t, fs in store.folders.items() for f in fs.values()], "folder string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    folder = F.regexp_extract("path", r"(/[^/]+/bucket=[^/]+/version=[^/]+/)[^/]*$", 1)
    return files.withColumn("folder", folder).where("folder <> ''").join(used, "folder", "left_anti").select("path")


def get_scan(scans: DataFrame, scan_id: str, buckets: int = BUCKETS) -> DataFrame:
    """One scan; on a stored table the bucket filter prunes partitions."""
    out = scans.where(F.col("scan_id") == scan_id)
    if "bucket" in scans.columns:
        out = out.where(F.col("bucket") == F.pmod(F.xxhash64(F.lit(scan_id)), F.lit(buckets)).cast("int"))
    return out


def to_scan_json(df: DataFrame, exclude=("raw_json",)) -> DataFrame:
    cols = [x for x in df.columns if x not in exclude]
    return df.withColumn("raw_json", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def from_scan_json(df: DataFrame, schema: str) -> DataFrame:
    return df.select("scan_id", F.from_json("raw_json", schema).alias("scan")).select("scan_id", "scan.*") \
        if "scan_id" not in schema else df.select(F.from_json("raw_json", schema).alias("scan")).select("scan.*")


def scan_document(df: DataFrame) -> DataFrame:
    """The stored JSON as a VARIANT (doc) that keeps whatever a scan holds; broken JSON gives NULL."""
    return df.withColumn("doc", F.try_parse_json("raw_json"))


def scan_values(df: DataFrame, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """scan_id and typed values out of the stored JSON: name -> (path, type), such as
    ``{"first": ("$.pages[0].url", "string")}``. A path that a scan lacks, or a value of another type,
    is NULL: documents of older and newer scans are read alike."""
    return scan_document(df).select("scan_id", *(F.try_variant_get("doc", p, t).alias(n) for n, (p, t) in paths.items()))


def scan_items(df: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """One row an element of a nested list (scan_id, pos and the named fields, typed), in order."""
    listed = scan_document(df).select("scan_id", F.posexplode(F.try_variant_get("doc", path, "array<variant>")).alias("pos", "item"))
    return listed.select("scan_id", "pos", *(F.try_variant_get("item", f"$.{n}", t).alias(n) for n, t in fields.items()))


def update_status(scans: DataFrame, updates: DataFrame) -> DataFrame:
    """New lead status per (scan_id, status), also as the top-level ``status`` of the stored JSON: nested
    statuses and all other values stay. Other rows are unchanged."""
    new = updates.where(F.col("status").isin(*STATUSES)).groupBy("scan_id").agg(F.max("status").alias("new_status"))
    df = scans.join(new, "scan_id", "left")
    changed = F.col("new_status").isNotNull()
    out = df.withColumn("status", F.coalesce("new_status", "status"))
    if "raw_json" in scans.columns:
        whole = F.try_parse_json("raw_json").cast("map<string,variant>")
        value = F.parse_json(F.concat(F.lit('"'), "new_status", F.lit('"')))
        fixed = F.coalesce(F.to_json(F.transform_values(whole, lambda k, v: F.when(k == "status", value).otherwise(v))), "raw_json")
        out = out.withColumn("raw_json", F.when(changed, fixed).otherwise(F.col("raw_json")))
    return out.select(*scans.columns)


def report_register(exports: DataFrame) -> DataFrame:
    """Latest report path per scan."""
    return exports.groupBy("scan_id").agg(F.max_by("pdf_path", F.struct("created_at", "pdf_path")).alias("pdf_path"))


def scan_history(scans: DataFrame, limit: int | None = None) -> DataFrame:
    """Scans, newest first, without their stored JSON."""
    ordered = scans.drop("raw_json").orderBy(F.desc("created_at"), "scan_id")
    return ordered if limit is None else ordered.limit(limit)


def recent_scans(scans: DataFrame, n: int = 10) -> DataFrame:
    return scan_history(scans, n)


def dashboard(scans: DataFrame, window: int | None = None) -> DataFrame:
    """One row over all scans, or the newest ``window``: total, high or critical, a count per level."""
    latest = scans if window is None else scan_history(scans.select("scan_id", "created_at", "risk_level"), window)
    by_level = latest.groupBy(F.coalesce(F.lower("risk_level"), F.lit("")).alias("level")).agg(F.count("*").alias("n"))
    return by_level.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("level").isin("high", "critical"), F.col("n"))), F.lit(0)).alias("high_critical"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("by_level"))


def export_results(summary: DataFrame, path: str, fmt: str = "csv"):
    """Bulk export of summary rows."""
    writer = summary.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
