"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a temporary one; on a cluster
    that is an error, as executors elsewhere could not read what the driver's machine holds."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallystone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def work_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors. The table is
    deleted when the driver ends, or by sweep()."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession | None = None) -> None:
    """Deletes the work tables of a session, or of all; results that still read them must be done."""
    for owner, path in [x for x in _written if spark is None or x[0] is spark]:
        _written.remove((owner, path))
        with contextlib.suppress(Exception):  # the session may be gone with its folder
            jvm = owner.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(sweep)
