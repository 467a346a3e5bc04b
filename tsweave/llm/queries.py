"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .common import table


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_sorted_id_shards(spark, sf_dir):
    from .sstable import token_shards

    return token_shards(table(spark, sf_dir, "documents"), _vocabulary())


def op7_simhash_components(spark, sf_dir):
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op1_byte_shards(spark, sf_dir):
    from .sharding import byte_shards

    return byte_shards(table(spark, sf_dir, "documents"))


def op2_benchmark_leaks(spark, sf_dir):
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_subword_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_nnls_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary()).drop("ids")


def op4_fuzzy_lines(spark, sf_dir):
    from pyspark.sql import functions as F

    from .linededup import without_repeated_lines

    found = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))


def op8_license_scan(spark, sf_dir):
    """Documents as files source/thousand/doc_id, so that a directory holds those of a source and a thousand of ids."""
    from pyspark.sql import functions as F

    from .licenses import scan

    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 1000").cast("string"), F.col("doc_id").cast("string"))
    found = scan(docs.select(path.alias("path"), "text"))
    return found.select(F.expr("try_cast(element_at(split(path, '/'), -1) as bigint)").alias("doc_id"), *found.columns)


def op9_flac_media(spark, sf_dir):
    from .media import media_features, store_texts

    return media_features(store_texts(table(spark, sf_dir, "documents")))


def op10_chat_paths(spark, sf_dir):
    from .chat import conversations, from_turns, read_back

    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return read_back(conversations(from_turns(rows)))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {name: text for name, text in vars(sql).items() if name.startswith("op")}
