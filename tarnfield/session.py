"""Session settings that the library's semantics rest on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Runtime settings: times are UTC; of duplicate JSON keys the last wins; new streams keep state on disk, with bounded memory.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def prepared(spark: SparkSession) -> SparkSession:
    """The same session with RUNTIME set; safe to call again.

    Functions for Python workers travel with their code (see the package's
    __init__), so executors need no copy of this package.
    """
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def session(app: str = "tarnfield", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (RUNTIME | more).items():
        builder = builder.config(key, value)
    return prepared(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It's the one that the cluster names in spark.checkpoint.dir. Only a
    one-process session (master local) without that setting gets a temporary
    folder; on a cluster a missing setting is an error, as a local folder
    would lose rows.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="tarnfield-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/tarnfield/{label}-{uuid.uuid4().hex}"
