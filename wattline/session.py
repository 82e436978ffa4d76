"""Spark session helpers.

The library never creates a cluster session on its own; ``get_session`` is a
convenience for tests, the bench and local runs.  Cluster jobs pass their own
session and keep whatever ``spark.checkpoint.dir`` the cluster configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults that matter for correctness of every query in this package.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "wattline", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on."""
    master = master or os.environ.get("WATTLINE_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(CORE_CONF)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 8),
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    })
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is kept as
    is; without one this raises, since a machine-local folder would give each
    executor its own files.  Only local masters get a fresh scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="wattline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def materialize(df, name: str):
    """Write ``df`` as a Parquet table under the session's checkpoint folder and
    return a DataFrame reading it back.

    Used where one intermediate result feeds several branches: each branch
    then reads the stored table (with its own column pruning) instead of
    recomputing it from the input, and the lineage is cut, so a lost executor
    does not recompute the chain before this point.  The folder is the shared
    ``spark.checkpoint.dir`` of the cluster (a scratch folder only when unset).
    """
    import uuid as _uuid
    spark = df.sparkSession
    path = f"{materialized_root(spark)}/{name}-{_uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialized_root(spark) -> str:
    """Folder of this application's materialised tables (one per application,
    under the shared checkpoint folder)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/wattline-tables/{spark.sparkContext.applicationId}"


class Scratch:
    """Tables that one job writes for itself, in a folder of its own; ``drop`` deletes them when
    it has ended, so a stream leaves none behind.  Called like ``materialize``."""

    def __init__(self, spark):
        import uuid as _uuid
        self.spark, self.path = spark, f"{materialized_root(spark)}/job-{_uuid.uuid4().hex}"

    def __call__(self, df, name: str):
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_materialized(spark) -> bool:
    """Delete this application's materialised tables once their results have
    been consumed (DataFrames built on them can no longer be read after it).
    Uses the Hadoop FileSystem of the folder, so it works on any shared store."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(materialized_root(spark))
    fs = path.getFileSystem(conf)
    return bool(fs.exists(path) and fs.delete(path, True))
