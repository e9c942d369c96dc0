"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a Parquet table and reading it back, so that a lost executor costs a
re-read and not a recomputation of every earlier round.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Bytes of the files that a query reads for each partition of :func:`spread`.
SPREAD = 8 << 20

_written: ContextVar[list[DataFrame] | None] = ContextVar("_written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset (tests), a folder below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it. The table goes when the
    application ends, or earlier by :func:`discard`. ``file_rows``: at most so many rows a file, for rows of megabytes: a
    task holds a file's rows at once when it writes them (a hundred at least, whatever their size) and when it reads them."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(where)
    path, fs = _path(spark, where)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._quill_path = where
    if (held := _written.get()) is not None:
        held.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are written within are discarded at the end, but for those that were added to the given list: these are
    left to the scratch around, if any. Nothing lazy may read the others afterwards."""
    around, mine, kept = _written.get(), [], []
    token = _written.set(mine)
    try:
        yield kept
    finally:
        _written.reset(token)
        spared = {getattr(t, "_quill_path", None) for t in kept}
        discard(*(t for t in mine if t._quill_path not in spared))
        if around is not None:
            around.extend(kept)


def measured(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict[str, float]]:
    """:func:`materialize`, with aggregates of the rows taken while they are written: no second job."""
    seen = Observation()
    out = materialize(df.observe(seen, *(c.alias(k) for k, c in sums.items())), name)
    return out, {k: float(v or 0.0) for k, v in seen.get.items()}


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """:func:`materialize` as a table in buckets by ``keys``, as many as the session's shuffle partitions: joins on them
    shuffle only the other side."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed_as_is(df.repartition(parts, *keys), name, *keys)


def bucketed_as_is(df: DataFrame, name: str, *keys: str, file_rows: int = 0) -> DataFrame:
    """:func:`bucketed` without a shuffle, for rows that are partitioned by ``keys``, or few: a task writes a file for each
    bucket that it has rows of. ``file_rows`` as in :func:`materialize`."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    where = f"{shared_dir(spark)}/{table}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, *keys).sortBy(*keys).option("path", where).option("compression", "zstd").option("maxRecordsPerFile", file_rows).saveAsTable(table)
    path, fs = _path(spark, where)
    fs.deleteOnExit(path)
    out = spark.table(table)
    out._quill_path, out._quill_table = where, table
    if (held := _written.get()) is not None:
        held.append(out)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys`` into as many parts as the size of the files that it comes from asks for, so that what a
    task aggregates does not grow with the tables; left as it is where they are small. For rows of which few share their
    keys: they are not combined before the shuffle."""
    spark, total = df.sparkSession, 0
    for file in df.inputFiles():
        path, fs = _path(spark, file)
        total += fs.getFileStatus(path).getLen()
    parts = math.ceil(total / SPREAD)
    return df.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys) if parts > 1 else df


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing lazy reads them any more."""
    for table in tables:
        where = getattr(table, "_quill_path", None)
        if where:
            if named := getattr(table, "_quill_table", None):
                table.sparkSession.sql(f"DROP TABLE IF EXISTS {named}")
            path, fs = _path(table.sparkSession, where)
            fs.delete(path, True)
