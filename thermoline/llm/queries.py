"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.llm import (
    bpe,
    byte_cnn,
    chosen_path,
    latent,
    lexical,
    licences,
    lines,
    ngram_ratio,
    packed,
    ppm,
    revisits,
    suffix_merge,
    whitening,
)
from thermoline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    def register(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLES[make.__name__] = sql
        return make
    return register


@query(revisits.SQL)
def op1_revisits(spark: SparkSession, folder: str) -> DataFrame:
    done = revisits.resolve_revisits(revisits.captures(table(spark, folder, "pages")))
    return done.withColumn("headers_md5", revisits.header_digest(F.col("headers"))).drop("headers")


@query()
def op2_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return chosen_path.near_duplicates(docs, shingle=3, percent=85).drop("text")


@query()
def op6_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return latent.contaminated(docs, table(spark, folder, "benchmark"))


@query(lines.SQL)
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = lines.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(licences.sql())
def op8_licence_digests(spark: SparkSession, folder: str) -> DataFrame:
    done = licences.scan_licences(table(spark, folder, "documents").select("doc_id", "text"))
    return done.drop("text")


@query(ngram_ratio.sql())
def op10_ngram_ratio(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").where("quality = 1")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ngram_ratio.quality_rules(docs, trusted).drop("text")


@query()
def op3_suffix_merge(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_merge.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op4_ppm_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    models = ppm.learn(docs.where(~held_out).select("lang", "text"))
    done = ppm.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), models)
    return done.drop("text")


@query()
def op5_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    network = byte_cnn.learn(docs.where(~held_out), table(spark, folder, "labels"))
    done = byte_cnn.classify(docs.withColumn("held_out", held_out), network)
    return done.drop("text")


@query()
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = tokenizer()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = bpe.encode_and_decode(docs, path, pattern).drop("text")
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query()
def op11_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    path = scratch_path(spark, "packed_ids")
    packed.write_ids(table(spark, folder, "documents").select("doc_id", "text"), path,
                     public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packed.with_crc32(packed.read_documents(spark, path))


@query()
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows, model, error = whitening.whiten(
        table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return whitening.by_component(rows, model, error)


@query(lexical.sql())
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, folder, "benchmark"))


def tokenizer() -> tuple[str, str]:
    """File and pattern of the public vocabulary that the queries use."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
