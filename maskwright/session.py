"""Sessions, and shipping the package to executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; partitions follow the cluster unless given."""
    builder = SparkSession.builder.appName("maskwright")
    builder = builder.master(master) if master else builder
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives executors the package, once for each application, so that functions can be loaded wherever it is not
    installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        copy = Path(tempfile.mkdtemp(prefix="maskwright-ship-"))
        shutil.copytree(root, copy / "package" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        _shipped[context.applicationId] = shutil.make_archive(str(copy / root.name), "zip", copy / "package")
        context.addPyFile(_shipped[context.applicationId])
