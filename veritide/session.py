"""Session factory and the folder for written state that all executors share."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
}


def session(app: str = "veritide", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; shuffle width follows the master's cores unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**_CONF, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir; only where that is unset (tests, one machine) a local one is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            root = current
        else:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="veritide-")
            spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, f"{what}-{uuid.uuid4().hex[:12]}")


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Rows dealt out over `per_core` tasks a core before a costly per-row stage, if the scan has fewer partitions than that.

    Only small inputs are dealt out: a large scan has partitions enough and is left alone.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
