"""Session construction and the shared working folder."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on (UTC, AQE, skew join)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> None:
    """Dates are UTC days everywhere; a session in another zone would shift the grain."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a session must name one.

    A machine-local folder would not survive the loss of that machine, so none is made up here.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is None:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured or os.path.dirname(sc.getCheckpointDir())


def cut_lineage(df):
    """Reliable checkpoint: the rows are read back from the shared folder afterwards."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def working_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for tables and stream checkpoints."""
    return f"{checkpoint_root(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store its scheme names."""
    sc = spark.sparkContext
    named = sc._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(sc._jsc.hadoopConfiguration()).exists(named)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    sc = spark.sparkContext
    named = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = named.getFileSystem(sc._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(named)] if system.exists(named) else []


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder and what is in it."""
    sc = spark.sparkContext
    named = sc._jvm.org.apache.hadoop.fs.Path(path)
    named.getFileSystem(sc._jsc.hadoopConfiguration()).delete(named, True)


def _package_bytes() -> bytes:
    folder = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for top, _, names in sorted(os.walk(folder)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(folder)))
    return held.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Gives every Python worker this package, once per application.

    Functions that run on executors name their module, so the workers must be able to import
    it wherever the driver was started. The archive goes to the shared folder.
    """
    sc = spark.sparkContext
    jvm = sc._jvm
    if getattr(sc, "_tidemark_shipped", False):
        return
    path = jvm.org.apache.hadoop.fs.Path(f"{working_path(spark, 'package')}/tidemark.zip")
    system = path.getFileSystem(sc._jsc.hadoopConfiguration())
    stream = system.create(path, True)
    stream.write(_package_bytes())
    stream.close()
    sc.addPyFile(system.makeQualified(path).toString())
    sc._tidemark_shipped = True
