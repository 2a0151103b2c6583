"""Session helpers: a local session for tests and benches, shipping the package to executors, and the shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: dict[str, str] = {}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with the settings that tests and bench.py use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("htmlframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Spark's own file server carries the archive, so executors need neither a shared folder nor an installed copy.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="htmlframe-"), "htmlframe_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("htmlframe", os.path.relpath(full, PACKAGE)))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, as the session's checkpoint folder.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="htmlframe-checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()
