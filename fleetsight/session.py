"""Session, checkpoint and scratch-table helpers.

Everything that has to outlive a lost executor (checkpoints, stream sinks, swap tables) is
written under the folder the cluster names in ``spark.checkpoint.dir``.  Only where that
setting is absent, as in local tests, a private temporary folder is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "*", app: str = "fleetsight", shuffle_partitions: int = 8,
                  memory: str = "16g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings every operator relies on.

    Size estimates do not see that ``explode`` makes hundreds of pixels of one row, so joins are broadcast
    by the measured sizes of finished stages only.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that it need not be installed there."""
    context = spark.sparkContext
    if getattr(context, "_fleetsight_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="fleetsight-")
    path = os.path.join(folder, "fleetsight.zip")
    with zipfile.ZipFile(path, "w") as out:
        for base, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    out.write(full, os.path.join("fleetsight", os.path.relpath(full, top)))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(path)
    context._fleetsight_shipped = True


def _base_dir(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get(_CONF, None) or spark.conf.get(_CONF, None)
    if base:
        return base
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{_CONF} must name a folder that all executors share; only a local master may do without it")
    base = tempfile.mkdtemp(prefix="fleetsight-", dir="/tmp")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(base)
    return base


_WRITTEN: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that finished queries of this session wrote to the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    path = f"{_base_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into reliable storage (never the executors' own disks)."""
    spark = df.sparkSession
    base = _base_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a parquet table in the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
