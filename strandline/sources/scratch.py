"""A session's folder for intermediate tables, where the driver and all executors can read and write."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``; a local one only where that is unset and the master is local."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="strandline-")
        _roots[app] = f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex[:12]}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session has ended before
        pass


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that owns it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()
