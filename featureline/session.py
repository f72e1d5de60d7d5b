"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "featureline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; cluster settings win where they exist."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
        # The alarm stream keeps its state in column families, which only this store has.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate tables through Spark's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``; none if it isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(target) if f.isDirectory()] if files.exists(target) else []


_own: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a folder of this machine, one for each process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault("base", "") or tempfile.mkdtemp(prefix="run-", dir="/tmp")
        _own["base"] = base
    return f"{base.rstrip('/')}/featureline/{name}-{uuid.uuid4().hex[:12]}"
