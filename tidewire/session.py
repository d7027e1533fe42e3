"""Session settings and the shared working folder."""

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "tidewire", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; keyword arguments override them."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``. Where it is unset (tests), one is chosen here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = "/tmp/tidewire-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidewire/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package() -> None:
    """Send this package to the Python workers, once per application.

    Backends and their adapters are unpickled there. Not needed where the package is installed on all
    nodes, and harmless then.
    """
    spark = SparkSession.active()
    app, package = spark.sparkContext.applicationId, os.path.dirname(os.path.abspath(__file__))
    if app in _shipped or not os.path.isdir(package):
        return
    # The driver's own copy; Spark sends it to the executors.
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tidewire"), "zip",
                                  root_dir=os.path.dirname(package), base_dir="tidewire")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
