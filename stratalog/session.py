"""The session's shared folder and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset (one machine), a temporary folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        have = sc._jsc.sc().getCheckpointDir()
        root = have.get() if have.isDefined() else None
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        root = Path(tempfile.mkdtemp(prefix="stratalog-")).as_uri()
        sc.setCheckpointDir(root)
    return root if ":" in root else Path(root).absolute().as_uri()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stratalog/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """The rows as a written table with all rows of a value in one bucket of so many; joins and groups of such tables by that column need no shuffle.

    Only a table in the catalogue has buckets; it is dropped from there at once, its files stay."""
    spark = df.sparkSession
    key = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/stratalog/{name}-{key[-32:]}"
    df.repartition(buckets, column).write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(f"stratalog_{key}")
    out = spark.table(f"stratalog_{key}").select(*df.columns)
    spark.sql(f"DROP TABLE stratalog_{key}")
    return out


def plain(df: DataFrame) -> DataFrame:
    """A written table without its buckets: joins shuffle it, so that Spark can split what is uneven."""
    files = df.inputFiles()
    return df.sparkSession.read.schema(df.schema).parquet(unquote(files[0].rsplit("/", 1)[0])) if files else df
