"""Shared places for intermediate tables.

A job cuts its lineage by writing a table below ``spark.checkpoint.dir`` and reading it again, so a lost executor
costs one stage and not the whole job.  The setting is read from the session.  Where it is unset, a session on this
machine alone (as in tests) gets a local folder, and a cluster's is refused.

A query removes its intermediate tables when its result is written; the folders of results go when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_lock, _writing = threading.Lock(), [0, "false"]


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir`` (not yet created)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loamdex-")
        spark.conf.set("spark.checkpoint.dir", base)
    place = f"{base.rstrip('/')}/loamdex-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, place))
    return place


def _remove_all() -> None:
    for spark, place in _made:
        try:
            removed(spark, place)
        except (Py4JError, OSError, AttributeError):  # the session is gone
            return


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, place: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder (below ``place``, if given) and read it again.

    The shuffle files of the job go when it ends: what follows reads the table.  The setting for that holds as long as
    any thread writes, and is put back by the last.
    """
    spark = df.sparkSession
    path = f"{place}/{name}-{uuid.uuid4().hex[:8]}" if place else f"{shared_dir(spark)}/{name}"
    with _lock:
        if not _writing[0]:
            _writing[1] = spark.conf.get(_CLEANUP, "false")
        _writing[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        with _lock:
            _writing[0] -= 1
            if not _writing[0]:
                spark.conf.set(_CLEANUP, _writing[1])
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, place: str) -> None:
    """Delete a folder of intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle by an own key is dealt into: the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
