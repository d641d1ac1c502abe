"""Session-dependent helpers: lineage cuts, shared work folders, size-checked broadcast."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side within both bounds may be broadcast; beyond them a shuffle join is used.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own;
    a cluster without it is an error, as a node-local folder would not survive.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return root
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="tickloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that later stages never recompute it differently."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def cut_and_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``cut_lineage``, and how many rows meet ``condition``, counted as they are written."""
    seen = Observation()
    cut = cut_lineage(df.observe(seen, F.count_if(condition).alias("n")))
    return cut, seen.get["n"]


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created or removed there."""
    return os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure rows and bytes of at most ``max_rows + 1`` rows: a proven bound, at a bounded price."""
    width = F.lit(0)
    for name, kind in df.dtypes:
        held = F.lit(0)
        if kind in ("string", "binary"):
            held = F.octet_length(name)
        elif kind.startswith(("array", "map", "struct", "variant")):
            # No element of a nested value takes less text than this, or more memory than eight times as much.
            held = 8 * F.octet_length(F.to_json(F.struct(name)))
        width = width + F.coalesce(held, F.lit(0)) + 16
    size = df.select(width.cast("bigint").alias("w")).limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("w"), F.lit(0)).alias("bytes")
    ).first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def ship_by_value(module: str) -> None:
    """Send this module's functions to the workers inside the task, so executors need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
