"""What the operators of this subpackage share: the shared folder, written tables, files and prefix sums."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, shared_dir

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run, task or operator uses."""
    return scratch(spark, name)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder. This cuts lineage; what is lost with an executor can be read again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that written() or new_folder() made and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def delete_table(df: DataFrame) -> None:
    """Remove the table that written() gave, which nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to, now and not when the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Remove all that this application has written in the shared folder. Frames that still read it can't be used after."""
    delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bound the bytes of the batches that go to Python, unless the session has its own bound, as texts can be very long."""
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "64MB", "2147483647b"):  # the defaults of different versions
        spark.conf.set(BATCH_BYTES, str(megabytes << 20))


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle makes: the session's setting, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or a plain path, for tasks that write or read files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, like `name`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


#: A key is hot if it has at least this share of the rows, so there are at most so many hot keys.
HOT_SHARE = 1024


def join_with_hot(rows: DataFrame, about: DataFrame, key: str, times: str, total: int) -> DataFrame:
    """rows joined with about on key, of which about has one row a key; rows of hot keys don't meet in one task.

    about tells in `times` how often a key is in rows at least, and total is the number of rows, so at most HOT_SHARE keys
    are hot and these are broadcast. The others are joined by a shuffle.
    """
    hot = about.where(F.col(times) * HOT_SHARE >= max(total, 1))
    cold = about.where(F.col(times) * HOT_SHARE < max(total, 1))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
