"""Token counts behind a digest cache.

The cache is a Parquet table (content_digest, n_tokens), partitioned by
tokenizer_digest, in a folder that all executors share.  A run digests the
normalised contents, joins them to the counts stored for this tokenizer
version, encodes each distinct miss once, appends the new counts and joins all
documents to the table.  Any part of an append is a valid cache, and rows that
two runs both append are read as one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import as_bytes, coder, slices
from .common import discard, hot_keys, join_spread, materialize, shared_dir

CACHE_SCHEMA = T.StructType([T.StructField("content_digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def normalised(text: Column) -> Column:
    """Content as far as counts depend on it: byte-level vocabularies tell all texts apart, so only null and empty fall together."""
    return F.coalesce(text, F.lit(""))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def tokenizer_digest(vocabulary: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(vocabulary, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _version_path(cache_path: str, version: str) -> str:
    return f"{cache_path}/tokenizer_digest={version}"


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """Stored counts of one tokenizer version, one row per content; None before the first run."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(_version_path(cache_path, version))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(misses: DataFrame, vocabulary: str) -> DataFrame:
    """(content_digest, text) to rows of the cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                _, counts = c.encode_batch(as_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array(counts, pa.int64())], CACHE_SCHEMA.names)

    return misses.mapInArrow(run, CACHE_SCHEMA)


def new_cache(spark: SparkSession) -> str:
    """Path of a cache that nothing has been stored in."""
    return f"{shared_dir(spark)}/shelfwise-llm/token-cache-{uuid.uuid4().hex}"


def store_counts(docs: DataFrame, vocabulary: str, cache_path: str, text_col: str = "text") -> None:
    """Encode each distinct content that the cache lacks for this tokenizer once, and append its count."""
    version, text = tokenizer_digest(vocabulary), F.col(text_col)
    contents = docs.select(content_digest(text).alias("content_digest"), normalised(text).alias("text"))
    # Copies fall together in the tasks that read them, before anything is moved.
    contents = contents.groupBy("content_digest").agg(F.first("text").alias("text"))
    stored, missing = read_cache(docs.sparkSession, cache_path, version), None
    if stored is not None:
        digests = docs.select(content_digest(text).alias("content_digest")).distinct()
        missing = materialize(digests.join(stored, "content_digest", "left_anti"), "token-misses")
        if missing.isEmpty():
            discard(missing)
            return
        contents = contents.join(missing, "content_digest", "left_semi")
    encode_misses(contents, vocabulary).write.mode("append").parquet(_version_path(cache_path, version))
    discard(missing)


def count_tokens(docs: DataFrame, vocabulary: str, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; appends what was missing to the cache.

    ``cache_path`` names a cache that lasts; without it a new one is begun.
    Null counts as empty: 0 bytes, 0 tokens.  Equal texts are encoded once,
    repeated rows all come back, an empty table gives an empty result.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    cache_path = cache_path or new_cache(spark)
    store_counts(docs, vocabulary, cache_path, text_col)
    counts = read_cache(spark, cache_path, tokenizer_digest(vocabulary))
    own = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(normalised(text)).cast("long").alias("n_bytes"), content_digest(text).alias("content_digest"))
    joined = join_spread(own, counts, "content_digest", hot_keys(own, "content_digest"))
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
