"""What the operators share: the cluster's shared folder, written intermediates, shipping code to workers."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset
    (a single machine, as in tests) a temporary folder that is then set as the checkpoint folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        root = Path(tempfile.mkdtemp(prefix="stratalog-")).as_uri()
        sc.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else Path(root).absolute().as_uri()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stratalog/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read back: a cut in the lineage that a lost executor doesn't undo.

    What the plan shuffled is deleted as soon as the rows are written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


#: Rows and bytes that go to a Python worker at once: whole texts are large, and both sides hold a batch several times.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "20000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def ship(spark: SparkSession) -> None:
    """Makes this package importable on Python workers where the driver's PYTHONPATH doesn't already, and keeps their batches small."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in paths or os.path.realpath(os.getcwd()) == str(ROOT) or getattr(spark.sparkContext, "_stratalog", False):
        return
    target = Path(tempfile.mkdtemp()) / "stratalog.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "stratalog").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._stratalog = True
    sys.path_importer_cache.clear()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system, where Arrow and the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
