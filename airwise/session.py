"""Spark session settings and the shared checkpoint folder.

On a cluster the session comes from the launcher and already names
``spark.checkpoint.dir`` (a shared, fault-tolerant folder).  Only when the
setting is absent (tests, local runs) do we pick a scratch folder ourselves.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  Time zone is pinned so dates derived from
# timestamps are the same on every executor; AQE re-plans joins and shuffle
# partition counts at runtime and splits skewed join partitions.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "airwise", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(ENGINE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Apply runtime-settable engine settings to a session we did not build."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        try:
            spark.conf.set(k, ENGINE_CONF[k])
        except Exception:  # noqa: BLE001 - static conf on a shared session
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only if unset and the master is local
    (an error on a cluster).  A folder made here goes when the process ends."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    master = spark.conf.get("spark.master", "local")
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder: each node of a cluster has a /tmp of its own")
    d = tempfile.mkdtemp(prefix="airwise-ckpt-", dir=os.environ.get("AIRWISE_SCRATCH", "/tmp"))
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
