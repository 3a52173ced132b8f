"""Session construction and the shared scratch folder.

Scratch data (checkpoints, written intermediate tables, round-trip files) always
goes below the folder the cluster names in ``spark.checkpoint.dir``.  Only when
that setting is absent (local runs and tests) do we choose one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes."""
    builder = SparkSession.builder.appName("scriptorium")
    if master:
        builder = builder.master(master)
    settings = dict(_DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is also the only executor
        settings["spark.driver.memory"] = os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A folder of this machine is chosen only for a local master (tests), where
    the driver is also the only executor; on a cluster a missing setting is an
    error, because executors could not see such a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no SparkContext, read the setting only
        if not configured:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share") from None
        return configured
    root = sc.getCheckpointDir()
    if root:
        return root
    root = configured or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="scriptorium-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder; Spark's writers create it."""
    return f"{checkpoint_root(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``scriptorium`` importable in Python workers (executors or local workers).

    Python-worker stages (``mapInPandas``) pickle their functions by module
    reference, so workers must import this package.  It is zipped once per
    session on the driver and distributed with ``SparkContext.addPyFile``,
    the same mechanism as ``--py-files``.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: packages are managed by the server
        return
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import scriptorium

    pkg_dir = os.path.dirname(os.path.abspath(scriptorium.__file__))
    base = os.path.dirname(pkg_dir)
    target = os.path.join(tempfile.mkdtemp(prefix="scriptorium-pyfiles-"), "scriptorium.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
