"""The corpus pipeline: documents to packed training sequences in five stages, each an operator of tsweave.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsweave.llm.common import table, text_or_empty, written
from tsweave.llm.decontaminate import leaks
from tsweave.llm.linededup import without_repeated_lines
from tsweave.llm.packing import pack
from tsweave.llm.simhash import near_duplicates
from tsweave.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can express none of the stages with a model, fingerprints or a tokenizer, so the run has no SQL.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents and `row`, a hash of identifier and text, by which operators judge each row by itself.

    Rows alike in both are judged alike. A null text hashes as an empty one.
    """
    return docs.select(*COLUMNS, F.xxhash64("doc_id", text_or_empty()).alias("row"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("row").distinct(), "row", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels of these documents, takes for toxic go."""
    rows = _rows(docs)
    return _without(rows, toxicity(rows, table(spark, sf_dir, "labels"), id_col="row").where("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that recur, alike or nearly so, one occurrence stays. All rows stay, with what is left of their text."""
    cut = without_repeated_lines(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of the smallest doc_id stays, a null one being the largest.

    Rows of one doc_id with unlike texts all stay; of rows that are alike in doc_id and text one does. Texts without
    words are near-duplicates of nothing.
    """
    rows = _rows(docs)
    worded = rows.where(text_or_empty().rlike(r"\S"))
    group = near_duplicates(worded, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    group = written(group.where("row is not null").distinct(), "document-groups")
    several = group.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    member = rows.select("row", "doc_id").distinct().join(group.join(several, "component_id"), "row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = member.groupBy("component_id").agg(F.min(order).alias("first"))
    gone = member.join(first, "component_id").where(F.col("row") != F.col("first.row"))
    wordless = rows.where(~text_or_empty().rlike(r"\S")).select(*COLUMNS)
    kept = worded.join(gone.select("row"), "row", "left_anti").dropDuplicates(["row"]).select(*COLUMNS)
    return kept.unionByName(wordless)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go."""
    rows = _rows(docs)
    return _without(rows, leaks(rows, table(spark, sf_dir, "benchmark"), id_col="row").withColumnRenamed("doc_id", "row"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids: the pieces of documents, with their ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
