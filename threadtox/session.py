"""Session construction and the shared scratch location.

On a cluster the scratch location is the shared folder named by ``spark.checkpoint.dir``; we only
pick a local folder when the session has none (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "threadtox",
                  extra: dict | None = None) -> SparkSession:
    """A session configured the way the library expects (AQE and skew handling on, UI off)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("THREADTOX_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python functions find it anywhere.

    The archive is made on the driver and served to the executors by Spark (``addPyFile``); it holds code only.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.suffix != ".zip" and root.is_dir():  # else the package is imported from an archive already
        archive = Path(tempfile.mkdtemp(prefix="threadtox-code-")) / "threadtox_code.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(Path(root.name) / f.relative_to(root)))
        sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, choosing a local one only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="threadtox-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh, unique path under the shared checkpoint folder (for written intermediate tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/threadtox-{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage of an intermediate that several later steps consume: without it, every consumer
    re-runs the whole upstream plan (Spark cannot share the shuffles once column pruning has made the
    branches differ). The files live in the cluster's shared folder, so a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/").split(":", 1)[-1]
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/threadtox-" in folder and base.lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def driver_bytes(spark: SparkSession) -> int:
    """The driver's heap."""
    return spark._jvm.java.lang.Runtime.getRuntime().maxMemory()


_MEMO: dict[tuple, str] = {}


def materialized_once(spark: SparkSession, key: tuple, build, partition_by: Sequence[str] = ()) -> DataFrame:
    """``materialize(build())`` once per (application, key); later calls read the same files. With ``partition_by``
    the files lie in one folder per value, and readers prune to those they need."""
    k = (spark.sparkContext.applicationId,) + tuple(key)
    path = _MEMO.get(k)
    if path is None:
        df = build()
        path = scratch_path(spark, "-".join(str(x) for x in key[:1]))
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
        _MEMO[k] = path
    return spark.read.parquet(path)
