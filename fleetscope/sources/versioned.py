"""Tables with versions: updates that really write (S8, S9) and report sinks.

A table is a folder of bucket folders (rows by the hash of one key column) and of manifests, one per version, that name the folder of
every bucket. An update writes only the buckets that its keys fall into, to new folders, and then makes the manifest of the next version
appear by one rename that fails if that version exists: a job that dies before it changes nothing, and of two writers that started
from one version the later gets ``VersionConflict``. Readers are pinned to the version they opened; older versions stay readable.

A bucket that outgrows the others is spread over several tasks and files (rebalanced writes), so a key may hold any share of the rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from .telemetry import update_by_key

BUCKETS = 64
BUCKET = "__bucket"


class VersionConflict(RuntimeError):
    """Another writer has made the next version first."""


def _rename_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder to a name that must not exist yet; False if it does. The shared store's own rename, the same on every machine."""
    from py4j.protocol import Py4JJavaError
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    paths = [fs.Path(p) for p in (source, target)]
    context = fs.FileContext.getFileContext(paths[0].toUri(), spark._jsc.hadoopConfiguration()) if paths[0].toUri().getScheme() else \
        fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    if context.util().exists(paths[1]):
        return False
    try:
        context.rename(*paths, gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


class VersionedTable:
    """One version of a table at ``root``; ``update`` and ``replace`` return the next one."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), manifest
        self.version, self.key = manifest["version"], manifest["key"]
        self.schema = T.StructType.fromJson(manifest["schema"])

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> VersionedTable:
        """The newest version, or a given one."""
        at = f"{root.rstrip('/')}/manifests/" + ("*" if version is None else f"{version:010d}")
        try:
            rows = spark.read.text(at).select("value", F.get_json_object("value", "$.version").cast("int").alias("version"))
            row = rows.orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        if row is None:
            raise LookupError(f"no table version at {at}")
        return cls(spark, root, json.loads(row["value"]))

    @classmethod
    def create(cls, df: DataFrame, root: str, key: str, buckets: int = BUCKETS, fmt: str = "parquet") -> VersionedTable:
        """Version 1, with the rows of ``df``."""
        start = {"version": 0, "key": key, "n": buckets, "format": fmt, "schema": df.schema.jsonValue(), "buckets": {}}
        return cls(df.sparkSession, root, start).replace(df)

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.manifest["n"])).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of this version (of some buckets). Columns added after a file was written are null in its rows."""
        places = [f"{self.root}/{p}" for b, p in sorted(self.manifest["buckets"].items()) if buckets is None or int(b) in buckets]
        if not places:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).format(self.manifest["format"])
        return (reader.option("header", "true") if self.manifest["format"] == "csv" else reader).load(places)

    def _write(self, df: DataFrame) -> dict:
        folder = f"data/{uuid.uuid4().hex}"
        rows = df.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET)
        writer = rows.write.format(self.manifest["format"]).partitionBy(BUCKET)
        (writer.option("header", "true") if self.manifest["format"] == "csv" else writer).save(f"{self.root}/{folder}")
        return {str(b): f"{folder}/{BUCKET}={b}" for b in self._buckets_of(df)}

    def _buckets_of(self, df: DataFrame) -> list[int]:
        return [r[0] for r in df.select(self._bucket().alias("b")).distinct().collect()]      # at most n numbers

    def _commit(self, buckets: dict, schema: T.StructType) -> VersionedTable:
        after = {**self.manifest, "version": self.version + 1, "buckets": buckets, "schema": schema.jsonValue()}
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(after),)], "value string").coalesce(1).write.text(draft)
        fs = self.spark._jvm.org.apache.hadoop.fs
        parent = fs.Path(f"{self.root}/manifests")
        parent.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(parent)
        if not _rename_if_absent(self.spark, draft, f"{self.root}/manifests/{after['version']:010d}"):
            raise VersionConflict(f"{self.root}: version {after['version']} was written by another job")
        return VersionedTable(self.spark, self.root, after)

    def replace(self, df: DataFrame) -> VersionedTable:
        """The next version, holding the rows of ``df`` alone."""
        return self._commit(self._write(df), df.schema)

    def update(self, updates: DataFrame, key: str, columns: list[str]) -> VersionedTable:
        """The next version: ``columns`` set where ``key`` matches (``update_by_key``). Only buckets that the keys fall into are written."""
        if key == self.key:
            touched = self._buckets_of(updates.where(F.col(key).isNotNull()))
        else:
            touched = self._buckets_of(self.read().select(key, self.key).join(updates.select(key).distinct(), key, "left_semi"))
        touched = [b for b in touched if str(b) in self.manifest["buckets"]]
        after = update_by_key(self.read(touched), updates, key, columns)
        fresh = self._write(after) if touched else {}
        return self._commit({**self.manifest["buckets"], **fresh}, after.schema)
