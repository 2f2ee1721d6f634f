"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bigru_lang, bpe, decision_list, deleted_interpolation, license_scan, media_chunks, prefix_table, ranked_search, semicrf_pii, setsketch, source_mix, token_alignment, token_cache
from .common import crc_class, documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def sha256_hex(column) -> F.Column:
    return F.sha2(column, 256)


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score_documents(documents(spark, sf_dir))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def _coding_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join("ids", ",")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coding_digests(bpe.code_documents(documents(spark, sf_dir), BYTE_BPE))


def op5_quality_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = decision_list.learn(*decision_list.labelled_cells(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return decision_list.judge_quality(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def quality_base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op5, which SQL can express."""
    return decision_list.judge_quality(documents(spark, sf_dir), []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op6_token_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of this run's own, so that equal runs do equal work: stored in a first pass, asked in a second.
    docs, cache = documents(spark, sf_dir), token_cache.new_cache(spark)
    token_cache.store_counts(docs, BYTE_BPE, cache)
    return token_cache.count_tokens(docs, BYTE_BPE, cache)


def op3_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_documents(documents(spark, sf_dir))
    parts = lambda ms: F.transform(ms, lambda m: F.concat_ws(":", m["license"], m["start"], m["stop"], m["reduction"], m["missing"], m["added"]))
    return found.select(
        "doc_id",
        "n_blocks",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.array_join(parts("matches"), ",").alias("matches"),
        F.array_join(parts("nearest"), ",").alias("nearest"),
    )


def op7_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = semicrf_pii.find_personal_data(docs, semicrf_pii.train(semicrf_pii.training_windows(docs)))

    def joined(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    counts = [_of_kind("base", kind).alias(f"n_{kind}") for kind in semicrf_pii.KINDS]
    return found.select("doc_id", *counts, sha256_hex(joined("base")).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def _of_kind(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.read_media(*media_chunks.store_media(documents(spark, sf_dir)))


def op9_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(documents(spark, sf_dir), width=2)


def op10_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = bigru_lang.train(bigru_lang.training_stretches(docs))
    return bigru_lang.predict(docs, net).withColumn("held_out", crc_class(F.col("doc_id")) == 0).select("doc_id", "held_out", "lang_pred", "score", "n_positions", "n_agreeing")


def op11_spill_counted_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


def op12_hybrid_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coding_digests(prefix_table.code_documents(documents(spark, sf_dir), PIECE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_deleted_interpolation,
            op2_source_mix,
            op3_license_compression,
            op4_bpe_forced_boundaries,
            op5_quality_decision_list,
            op6_token_digest_cache,
            op7_pii_semicrf,
            op8_media_chunks,
            op9_setsketch_near_duplicates,
            op10_bigru_language,
            op11_spill_counted_alignment,
            op12_hybrid_ranked_search,
            op13_prefix_table_pieces,
            quality_base_statistics,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": source_mix.ORACLE, "op12_hybrid_ranked_search": ranked_search.ORACLE, "quality_base_statistics": decision_list.BASE_ORACLE}
