"""Getting this package to the Python workers of the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import tagloom

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Spark send the package to all executors, also those that start later; once per session.

    The archive only leaves the driver through Spark's own file distribution.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(tagloom.__file__).parent
    folder = tempfile.mkdtemp(prefix="tagloom-code-")
    archive = shutil.make_archive(f"{folder}/tagloom", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
