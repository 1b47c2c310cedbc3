"""Session settings the operators rely on, and durable cut points."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; all of them may be set on a running session.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers are pickled by module name, so every worker
    must be able to import the package.
    """
    context = spark.sparkContext
    if getattr(context, "_faultline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    kept = tempfile.NamedTemporaryFile(prefix="faultline-", suffix=".zip")
    with zipfile.ZipFile(kept, "w") as archive:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    kept.flush()
    context.addPyFile(kept.name)  # served to the executors by the driver while it runs
    context._faultline_shipped = kept


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut points and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is
    used only where nothing is set, which is the case in local tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="faultline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Spark removes the shuffle files of a query at its end where this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan below is evaluated once, and a lost executor costs a re-read of
    the written files instead of a recomputation of the whole lineage. The
    shuffle files of the plan are of no more use then and are removed.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("error").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scan of fewer splits than cores, as one small file gives.

    A scan with enough splits, which is any large table, stays as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
