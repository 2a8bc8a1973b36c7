"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.sources import interim
from tapeline.sources.interim import shared_dir

#: Rows and bytes of one Arrow batch, so that a Python worker holds a bounded slice of long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20

#: Rows that a task decodes from Parquet at a time, where Spark has 4,096: its buffers hold all their texts, and double as they grow.
READ_ROWS = 512

#: Separators between words: space and the ASCII controls tab to carriage return (fixed values).
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "READ_ROWS", "WORD", "hinted_broadcasts_only", "log_softmax", "looked_up", "pruned_by_keys", "read_table", "row_key", "row_name", "scratch", "session_settings", "shared_dir", "small_batches", "small_reads", "written"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder, in the shared one, of the tables that the innermost `scratch` deletes.
_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df written to the shared folder and read back. Within `scratch` it goes at the end of that, unless it is lasting."""
    return interim.written(df, name if lasting else _SCRATCH.get() + name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted afterwards, so what is returned must read only lasting ones."""
    folder = f"scratch-{uuid.uuid4().hex}"
    before = _SCRATCH.set(folder + "/")
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tapeline/{folder}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], n: str, frequent: float, fits: Column | None = None) -> DataFrame:
    """rows with the row of table that has the same keys and fits; keys with n above `frequent` are broadcast, so no task gets all rows of one.

    n counts a key's rows, so there are at most all rows / frequent such keys.
    """
    fits = F.lit(True) if fits is None else fits
    often = table.where(F.col(n) > frequent)
    rest = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(often.where(fits)), keys).unionByName(rest.join(table.where(fits & (F.col(n) <= frequent)), keys))


@contextmanager
def session_settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings for the jobs run inside, put back afterwards. Names with __ for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def pruned_by_keys(spark: SparkSession):
    """Within: joins with a written table of a few keys first drop rows of the other side by Spark's runtime Bloom filter, which
    is at most 8 MB whatever the input; where the table is larger than the setting, no filter is made and the join stays as it is."""
    bloom = "spark__sql__optimizer__runtime__bloomFilter__"
    return session_settings(spark, **{bloom + "enabled": "true", bloom + "applicationSideScanSizeThreshold": "0", bloom + "creationSideThreshold": "512MB"})


def hinted_broadcasts_only(spark: SparkSession):
    """Within: joins are broadcast only where a hint says so, so that plans are alike at every size of the input."""
    return session_settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")


def row_name(ident: str, *cols: str) -> Column:
    """Text key of a row's id and content, never null."""
    return F.concat(row_key(*cols).cast("string"), F.coalesce(F.concat(F.lit(":"), F.col(ident).cast("string")), F.lit("")))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small_reads(spark: SparkSession) -> None:
    """Bound what a task decodes from Parquet at once. It stays set, as what is returned is read later."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def row_key(*cols: str) -> Column:
    """64-bit key of a row's content, never null; used together with the id, which need not be unique."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in cols])


def log_softmax(values: Column) -> Column:
    """Natural-log softmax of an array<double>."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(values, lambda v: v - top - F.log(total))
