"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master, where it is unset, a temp folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="easel-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Parquet looks at a row group's size after 100 rows at first; of rows of megabytes that is more than a task's memory.
_LARGE = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def stage(df: DataFrame, name: str, keep: bool = False, large: bool = False) -> DataFrame:
    """Write df as Parquet and read it back; an empty table stays readable. keep: also beyond scratch(). large: rows are
    of megabytes, so row groups, which writers and readers hold whole, end after 16 MB or one row."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(_LARGE if large else {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    if _lists() and not keep:
        _lists()[-1].append(out)
    return out


_open = threading.local()


def _lists() -> list[list[DataFrame]]:
    """This thread's open scratch() blocks."""
    return _open.__dict__.setdefault("lists", [])


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of joins that deal out both sides: for tables that grow with the input. A side below Spark's broadcast
    limit would be built in the driver, once for each join of a plan that has it, and plans have many at a time."""
    return df.hint("merge")


@contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside are deleted at the end: for steps whose result is written inside, or that are over."""
    _lists().append([])
    try:
        yield
    finally:
        for df in _lists().pop():
            unstage(df)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later result reads, if it is still there."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
