"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import bpe, decision_list, semicrf_pii, setsketch, source_mix
from shelfwise.llm.common import documents, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep.

    Null and empty texts have no words and go; repeated rows get equal
    verdicts, rows that are kept come back as often and as they were.  Without
    labels the base rules alone decide; an empty table stays empty.
    """
    rules = decision_list.learn(*decision_list.labelled_cells(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return decision_list.kept_documents(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest id.

    Texts without words are linked with nothing and stay, as do rows without
    an id.  Of several rows under one id the one stays whose text has the
    lowest digest (then whose other columns come first), so reruns agree.  An
    empty table stays empty.
    """
    kept = setsketch.near_duplicates(docs, width=5, percent=80).where("kept").select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])))
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("_row"))
    return one.select("_row.*").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and their new lengths; no row goes.

    Null and empty texts stay what they are, repeated rows are changed alike,
    other columns are not touched; an empty table stays empty.
    """
    field = semicrf_pii.train(semicrf_pii.training_windows(docs))
    return semicrf_pii.redact_documents(docs, field).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, their columns unchanged.

    A null source is one of its own, a null text has size 0.  Repeated rows
    are taken one by one; ties at a source's cut are settled by key, then row
    number.  An empty table stays empty.
    """
    return source_mix.mixed_rows(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, their number and digest, and the digest of the text that they decode to.

    A null text counts as empty: no ids.  Repeated rows are encoded alike; an
    empty table gives an empty result.
    """
    return bpe.code_documents(docs, VOCABULARY).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixing", source_mixing),
    ("bpe encoding", bpe_encoding),
]

#: Learned rules, sketches and merges have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
