"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Only used when a local session names no shared folder (tests, laptops).
_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "tagloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this toolkit is tuned for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    A local session may leave it unset and gets a fresh temporary folder. On a cluster a
    machine-local folder would be lost with its machine, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app_id = spark.sparkContext.applicationId
    if app_id not in _local_dirs:
        _local_dirs[app_id] = tempfile.mkdtemp(prefix="tagloom-")
    return _local_dirs[app_id]


# Applications and folders of open ``intermediates`` blocks, the innermost last; each thread has its own.
_scopes: ContextVar[tuple[tuple[str, str], ...]] = ContextVar("scopes", default=())


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of this block go to a folder of their own, deleted when it ends.

    Results must be written or collected inside the block.
    """
    folder = f"{shared_dir(spark)}/intermediates-{uuid.uuid4().hex}"
    token = _scopes.set((*_scopes.get(), (spark.sparkContext.applicationId, folder)))
    try:
        yield folder
    finally:
        _scopes.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    own = [folder for app, folder in _scopes.get() if app == spark.sparkContext.applicationId]
    return f"{own[-1] if own else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and freezes values that would differ on recomputation. Lost executors
    lose nothing: the table stays in the shared folder.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
