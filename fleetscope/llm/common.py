"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only when it was counted and holds at most so many rows
# (of a few longs each, so some 20 MB); beyond that the join shuffles.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) without the setting gets a folder of its own;
    a cluster without the setting is an error, because a machine-local folder
    would be invisible to the other machines.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetscope-llm-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a staged table) with a broadcast hint if it was counted to be small, else unchanged."""
    return F.broadcast(df) if df.count() <= limit else df


def words_of(text):
    """Words of a text: maximal runs of characters other than space, tab, LF, VT, FF, CR; A-Z lower-cased."""
    import string
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge table (long columns ``a``, ``b``).

    Returns (``id``, ``component_id``) for every id in an edge; the component id
    is the smallest id of the component. Null ends and loops are ignored.

    Rounds of contraction: every node moves to the smallest neighbour (in an
    order shuffled by a hash that maps longs one to one, so chains shrink by a
    constant factor per round), the edges are rewritten to the moved nodes and
    repeated ones dropped. All steps are joins and partial aggregates, so a
    node with very many neighbours is never gathered anywhere.
    """
    e = stage(edges.where("a is not null and b is not null and a <> b")
              .select(F.xxhash64(F.col("a").cast("long")).alias("u"), F.xxhash64(F.col("b").cast("long")).alias("v"))
              .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    ids = (edges.where("a is not null and b is not null and a <> b")
           .select(F.explode(F.array(F.col("a").cast("long"), F.col("b").cast("long"))).alias("id")).distinct()
           .select("id", F.xxhash64("id").alias("node")))
    labels = stage(ids.withColumn("root", F.col("node")).select("id", "node", "root"), "labels")
    while not e.isEmpty():
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
                        .alias("x")).select("x.u", "x.v")
        up = stage(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "up")
        e = stage(e.join(up.withColumnRenamed("p", "pu"), "u")
                  .join(up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
                  .where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
                  .distinct(), "edges")
        labels = stage(labels.join(up.withColumnRenamed("u", "root"), "root", "left")
                       .select("id", "node", F.coalesce("p", "root").alias("root")), "labels")
    least = labels.groupBy("root").agg(F.min("id").alias("component_id"))
    return labels.join(least, "root").select("id", "component_id")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def default_tokenizer() -> str:
    """Place of the vocabulary file; a parameter of every function that reads it."""
    return os.environ.get("FLEETSCOPE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
