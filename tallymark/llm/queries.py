"""The registered queries of this package, each over its whole table, and SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import ann, bpe, decontam, linededup, lm, merkle, mixing, pii, toxicity, urls, vectorcodes
from tallymark.llm.common import lowered
from tallymark.llm.licences import licence_scan
from tallymark.llm.simhash import simhash_groups

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Runner], Runner]:
    def add(run: Runner) -> Runner:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op1_licences")
def op1_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licence_scan(table(spark, folder, "documents")).drop("spans")


@register("op2_personal_data")
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data_counts(pii.find_personal_data(table(spark, folder, "documents")))


@register("op3_simhash")
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents"))


@register("op4_decontamination")
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document that covers a benchmark item; clean documents have none."""
    return decontam.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@register("op5_nearest")
def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op6_line_dedup", linededup.ORACLE)
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@register("op7_lm_scores")
def op7_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(table(spark, folder, "documents"))


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score_toxicity(docs, model)


@register("op9_mixing", mixing.ORACLE)
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.drop("u", "copies")


@register("op10_urls", urls.ORACLE)
def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages")).drop("trust", "distrust")


@register("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, folder, "documents")
    return bpe.digests(bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, decoded=True))


@register("op12_merkle", merkle.ORACLE)
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    manifest = merkle.merkle_manifest(
        table(spark, folder, "documents"),
        tampered={"text": lowered(F.col("text"))},
        when=merkle.chosen_for_tampering(F.col("doc_id")),
    )
    return merkle.checked(manifest)


@register("op13_vector_codes", vectorcodes.ORACLE)
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes, books = vectorcodes.compress_vectors(table(spark, folder, "embeddings"))
    whole = vectorcodes.with_label_errors(codes)
    digest = F.lit(vectorcodes.book_digest(books)).alias("codebooks_sha256")
    return whole.select("vec_id", "code", "error", "label_error", digest)
