"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; set here only where it is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="concord-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def local(path: str) -> str:
    """A path that every executor can open; the shared folder must be mounted as a file system."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {path}")
    return parsed.path


def nested(docs: DataFrame, only: list[str] | None = None, /, **columns: Column) -> DataFrame:
    """Rows whole (or the columns `only` of them) in one column, row, beside columns of an operator's own: no name in docs can clash with those. row.* gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in only or docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def few(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """df, which has `rows` rows of two or three short keys at most, marked for a broadcast if these are not over `most` (some 20 MB)."""
    return F.broadcast(df) if rows <= most else df


def rows_for(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df, of `rows` rows at most, in no more partitions than there are `each` rows; larger tables stay as they are dealt."""
    n = -(-rows // each) or 1
    return df.coalesce(max(6, n)) if n < 64 else df


_open: list[list[str]] = []  # paths of tables written within each scratch() that is open, on the driver


@contextmanager
def scratch(spark: SparkSession):
    """Tables that written() makes within are deleted at its end, but for those made with keep=True, which belong to the scratch() around it, if there is one."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder; one that is gone already is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def at_exit(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read again, and its path: it stays until forget()."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder, read again: later steps don't compute it anew, and lost executors take nothing with them. keep: see scratch().

    Outside of any scratch() the table may be what a lazy result reads, so it stays as long as the driver does.
    """
    out, path = stored(df, name)
    hold(df.sparkSession, path, keep=keep)
    return out


def hold(spark: SparkSession, path: str, *, keep: bool = False) -> None:
    """Have a table that stored() made deleted when written() says."""
    scopes = _open[:-1] if keep else _open
    if scopes:
        scopes[-1].append(path)
    else:
        at_exit(spark, path)
