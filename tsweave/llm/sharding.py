"""Operator 1: contiguous shards of near-equal bytes, by prefix sums. DataFrame functions only.

Documents are put in order of identifier by ranges. Each partition's bytes and rows are summed; running totals of these
few sums, on the driver, are where each partition starts; within it a running sum goes on. A document goes to the shard
its middle byte falls in, so a shard's bytes differ from the target by less than its first and last document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, text_or_empty, written

OVERHEAD = 8


def byte_shards(docs: DataFrame, shards: int = 24, *, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; slot numbers a shard's rows from 0.

    Defined results: a null text has no bytes and CRC-32 0; a null identifier comes first; rows of the same identifier
    follow one another by CRC-32 and size, and those that are alike in all of these are interchangeable; with fewer rows
    than shards some shards are empty; a document larger than a shard's target fills the shard its middle falls in; an
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.encode(text_or_empty(text_col), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # rows alike in all that orders them are dealt by a hash of their place, so that many don't fill one partition
    rows = rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "deal").drop("deal")
    rows = written(rows.withColumn("pid", F.spark_partition_id()), "sizes")
    starts, total, count = [], 0, 0
    for r in rows.groupBy("pid").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("pid").collect():
        starts.append((r.pid, total, count))
        total, count = total + r.b, count + r.n
    base = F.broadcast(spark.createDataFrame(starts, "pid int, bytes_before long, rows_before long"))
    order = Window.partitionBy("pid").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    rows = rows.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(order) - 1)
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")  # twice the middle byte
    rows = rows.join(base, "pid").withColumn("shard", F.least(F.floor(middle * shards / (2 * max(total, 1))), F.lit(shards - 1)).cast("int"))
    rows = rows.withColumn("place", F.col("rows_before") + F.col("at"))
    rows = written(rows.select("doc_id", "size", "text_crc32", "shard", "place"), "shards")
    first = F.broadcast(rows.groupBy("shard").agg(F.min("place").alias("first")))  # one row for each shard
    return rows.join(first, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
