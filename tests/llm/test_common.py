import os

from tsweave.llm import common


def test_written_tables_and_clear(spark):
    df = common.written(spark.createDataFrame([(1, None)], "a long, b string"), "t")
    assert [tuple(r) for r in df.collect()] == [(1, None)] and df.schema["b"].dataType.simpleString() == "string"
    folder = f"{common.shared_dir(spark)}/{spark.sparkContext.applicationId}"
    fs, place = common.filesystem(folder)
    assert fs.get_file_info(place).type.name == "Directory"
    common.clear(spark)
    assert fs.get_file_info(place).type.name == "NotFound"


def test_file_systems():
    assert common.filesystem("/a/b")[1] == "/a/b" and common.filesystem("file:///a/b")[1] == "/a/b"
    assert os.sep == "/"


def test_bounded_batches(spark):
    common.bounded_batches(spark)
    assert spark.conf.get(common.BATCH_BYTES) != "67108864b"
    spark.conf.set(common.BATCH_BYTES, "12345")
    common.bounded_batches(spark)
    assert spark.conf.get(common.BATCH_BYTES).startswith("12345")
    spark.conf.unset(common.BATCH_BYTES)
