"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_ROOT: str | None = None
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "formwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects, and those given as `conf`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Keeps the state of large streams on the executors' disks and in the checkpoint, not on the heap.
        "spark.sql.streaming.stateStore.providerClass": _STATE_STORE,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder: on a cluster that folder would be
    visible to one machine and lost with it.
    """
    global _LOCAL_ROOT
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="formwright-")
    return _LOCAL_ROOT


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
