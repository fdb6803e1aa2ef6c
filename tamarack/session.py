"""Session settings, shipping of the package to executors, and durable intermediate results."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(name: str = "tamarack", **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI errors; ``settings`` override."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"} | settings
    builder = SparkSession.builder.appName(name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session, as ``--py-files`` does."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tamarack-")) / "tamarack.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in root.rglob("*.py"):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder if all runs on one machine."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tamarack-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
