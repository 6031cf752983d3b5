"""The training-data pipeline: each stage is written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.llm import bpe, chosen_path, latent, lines, ngram_ratio
from thermoline.llm.queries import table, tokenizer
from thermoline.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep; the raw corpus is what comes in."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return ngram_ratio.quality_rules(docs, trusted).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that three or more of them hold stay in the last one."""
    done = lines.drop_repeated_lines(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words and a similarity of 0.8 link."""
    return chosen_path.near_duplicates(docs, shingle=5, percent=80).where("kept").select(
        *docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Rows are told apart by numbers of their own, so
    that those without doc_id, or with another row's, go or stay by their own text."""
    numbered = materialize(docs.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    hits = latent.contaminated(numbered.select(F.col("_number").alias("doc_id"), "text"),
                               table(spark, sf_dir, "benchmark"))
    held = materialize(hits.select(F.col("doc_id").alias("_number")).distinct(), "contaminated")
    return numbered.join(held, "_number", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives its text again."""
    path, pattern = tokenizer()
    done = bpe.encode_and_decode(docs, path, pattern)
    return done.select("doc_id", "lang", "source", "n_tokens", "ids",
                       F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("same"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup),
          ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("tokens", tokens)]

#: SQL cannot express the search for near duplicates, the latent space or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
