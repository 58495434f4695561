"""Documents to packed training sequences: five stages, each written as Parquet and read again as the next one's input."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadwise.llm import mixing, packing, simhash, substring, toxicity
from threadwise.llm.shared import stored, table, text_key, word_count


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs, shingle=3, max_bits=3)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs.select(
        "doc_id", "source", text_key(F.col("text")).alias("cluster"), word_count(F.col("text")).alias("length")))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The fitted classifier, hash orders and spanning forests have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
