"""Store of fitted models (S11): fitted once per input, settings and code.

A fit is stored under a key: the fingerprint of the input files (path, size, modification time), the settings, and the code of this
package. Tables, models and values of one fit go to a folder of their own; a manifest row that names the folder is appended
last. Readers look only at manifests, so a fit that failed half-way is never seen, and two fits of one key never mix. A manifest whose
key differs from the wanted one is refused (``StaleModel``) and ``get_or_fit`` fits again.
"""

from __future__ import annotations

import functools
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boosting import BoostedTrees
from ..operators.forest import Forest
from ..operators.kernel_svm import KernelSvm
from ..session import checkpoint_dir

MANIFEST = "key string, folder string, saved_at long, body string"


class StaleModel(LookupError):
    """No stored fit has the wanted key."""


@dataclass
class Fit:
    """What is stored together: tables, models, and JSON values."""
    frames: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, object] = field(default_factory=dict)
    values: dict = field(default_factory=dict)


@functools.lru_cache(maxsize=1)
def code_version() -> str:
    root = Path(__file__).resolve().parents[1]
    digest = hashlib.sha256()
    for path in sorted(p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts):
        digest.update(str(path.relative_to(root)).encode() + path.read_bytes())
    return digest.hexdigest()


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the listing of the input files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"),
                    F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")).alias("sum")).first()
    return hashlib.sha256(f"{row['n']}|{row['size']}|{row['sum']}".encode()).hexdigest()


def save_model(spark: SparkSession, model, path: str) -> str:
    """Write a fitted model to ``path``; returns its kind, which ``load_model`` needs."""
    if isinstance(model, BoostedTrees):
        model.save(spark, path)
        return "trees"
    if isinstance(model, KernelSvm | Forest):
        values = model.to_values()
        if isinstance(model, Forest):           # its nodes go along
            for level in range(model.levels):
                model.nodes(spark, level).write.parquet(f"{path}/nodes/level={level}")
            values["path"] = path
        spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.text(f"{path}/values")
        return "forest" if isinstance(model, Forest) else "kernel"
    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().overwrite().save(path)
    return "pipeline" if isinstance(model, PipelineModel) else "stage"


def load_model(spark: SparkSession, kind: str, path: str):
    if kind == "trees":
        return BoostedTrees.load(spark, path)
    if kind in ("kernel", "forest"):
        values = json.loads(spark.read.text(f"{path}/values").first()["value"])
        return KernelSvm(**values) if kind == "kernel" else Forest.from_values(values)
    model = PipelineModel.load(path)
    return model if kind == "pipeline" else model.stages[0]


class ModelStore:
    """Fits under ``root``, by default ``models`` in the shared folder of the session (or ``spark.fleetscope.store``)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or spark.conf.get("spark.fleetscope.store", None) or f"{checkpoint_dir(spark).rstrip('/')}/models").rstrip("/")

    def key(self, inputs: list[str], settings) -> str:
        text = json.dumps([input_fingerprint(self.spark, inputs), settings, code_version()], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    def save(self, name: str, key: str, fit: Fit) -> None:
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        kinds = {}
        for i, (label, model) in enumerate(fit.models.items()):
            kinds[label] = [f"model-{i}", save_model(self.spark, model, f"{folder}/model-{i}")]
        for label, df in fit.frames.items():
            df.write.parquet(f"{folder}/frame-{label}")
        body = json.dumps({"models": kinds, "frames": list(fit.frames), "values": fit.values})
        row = [(key, folder, time.time_ns(), body)]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}/manifests")

    def load(self, name: str, key: str) -> Fit:
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{name}/manifests").where(F.col("key") == key)
            row = rows.orderBy(F.desc("saved_at"), "folder").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        if row is None:
            raise StaleModel(f"{name}: nothing stored for this input, these settings and this code")
        body = json.loads(row["body"])
        fit = Fit(values=body["values"])
        for label, (place, kind) in body["models"].items():
            fit.models[label] = load_model(self.spark, kind, f"{row['folder']}/{place}")
        fit.frames = {label: self.spark.read.parquet(f"{row['folder']}/frame-{label}") for label in body["frames"]}
        return fit

    def get_or_fit(self, name: str, inputs: list[str], settings, fit: Callable[[], Fit]) -> Fit:
        """The stored fit of the key, else ``fit()``, stored and read back."""
        key = self.key(inputs, settings)
        try:
            return self.load(name, key)
        except StaleModel:
            self.save(name, key, fit())
            return self.load(name, key)
