"""Ranked lexical search over all documents by a hybrid of term-at-a-time and document-at-a-time reading.

An index holds, per segment of documents, the posting lists of the terms that
a block of queries has.  Within a segment the short lists of a query are read
term at a time: their contributions are summed into accumulators, which then
act as one more posting list, with the largest sum as its bound.  This list
and the long lists are read together in document order, a range of documents
at a time: those lists whose bounds together cannot reach the worst score that
is still listed (ties included) name no candidates, they are only looked up
for candidates that the others name, the best bounded first, and skipped
where a candidate cannot come up any more.  Scores are exact integers.

Every task keeps the best of its own segments for each query, so that what it
must reach rises from segment to segment; Spark ranks what the tasks list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import as_bytes, slices
from .common import discard, materialize

#: Bytes of text and documents of a segment; bytes of query text in a block; a list is short up to this share of a segment; documents of a range.
SEGMENT_BYTES, SEGMENT_DOCS, BLOCK_BYTES, SHORT_SHARE, RANGE = 8_000_000, 65_536, 2_000_000, 1 / 16, 512
#: A hit without an id stands behind all others of its score.
_NO_ID = np.iinfo(np.int64).max

# Bytes that stand in terms: digits, letters, and all of characters beyond ASCII; only A-Z change.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order and with repeats."""
    return text.translate(_FOLD).split()


def packed(*columns: np.ndarray) -> list[bytes]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return [squeeze(c.astype(np.int32).tobytes()) for c in columns]


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32).astype(np.int64)


# Index --------------------------------------------------------------------------


def segment_index(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per segment: ids, lengths in terms, n_filled (documents with a term), n_terms, and the lists of ``terms``: term numbers, their sizes, documents and occurrences one list after another.

    Written to the shared folder.  ``terms`` is one block's and bounded; documents have integer ids or none.
    """
    wanted = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.BinaryType()), T.StructField("n_filled", T.LongType()), T.StructField("n_terms", T.LongType())]
        + [T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("docs", T.BinaryType()), T.StructField("tf", T.BinaryType())]
    )
    shared = wanted.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        get, width = number.get, max(1, len(number))

        def closed() -> pa.RecordBatch:
            every = np.concatenate(found) if found else np.empty(0, np.int64)
            keys, tf = np.unique(every, return_counts=True)
            term = keys // SEGMENT_DOCS
            first = np.flatnonzero(np.diff(term, prepend=-1))
            sizes = np.diff(np.append(first, len(term)))
            blobs = packed(np.array(lengths, np.int64), keys % SEGMENT_DOCS, tf)
            lists = [pa.array([term[first].tolist()], pa.list_(pa.int32())), pa.array([sizes.tolist()], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([blobs[0]], pa.binary()), pa.array([sum(n > 0 for n in lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64()), *lists, pa.array([blobs[1]], pa.binary()), pa.array([blobs[2]], pa.binary())],
                schema.names,
            )

        ids, lengths, found, held = [], [], [], 0
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                    if held > SEGMENT_BYTES or len(ids) == SEGMENT_DOCS:
                        yield closed()
                        ids, lengths, found, held = [], [], [], 0
                    own = terms_of(text)
                    known = [i for i in map(get, own) if i is not None]
                    if known:
                        found.append(np.array(known, np.int64) * SEGMENT_DOCS + len(ids))
                    ids.append(doc)
                    lengths.append(len(own))
                    held += len(text)
        if ids:
            yield closed()

    return materialize(wanted.mapInArrow(run, schema), "search-index")


def term_weights(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, weights): documents with a term, terms of all documents, and each term's weight by the documents that hold it."""
    counted = index.agg(F.sum("n_filled").alias("n"), F.sum("n_terms").alias("l")).first()
    n, length = counted["n"] or 0, counted["l"] or 0
    df = np.zeros(n_terms, np.int64)
    lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    for r in lists.collect():  # at most one row per term of the block
        df[r["terms"]] = r["df"]
    return n, length, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)


# Reading ------------------------------------------------------------------------


def length_norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents with ``lengths`` terms: 50 and fifty times their length over the mean."""
    if not total:
        return np.full(len(lengths), 50, np.int64)
    if int(lengths.max(initial=0)) * 50 * n < 1 << 63:
        return 50 + 50 * lengths * n // total
    return np.array([50 + 50 * int(x) * n // total for x in lengths], np.int64)


def contribution(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Best:
    """The ``k`` highest scores of a query so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.append(self.ids, ids), np.append(self.scores, scores)
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


class Postings:
    """One list of a segment, or the accumulators of several, in document order; ``most`` bounds what it adds to a document."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray):
        self.docs, self.scores = docs, scores
        self.most = int(scores.max(initial=0))

    def at(self, docs: np.ndarray) -> np.ndarray:
        """What it adds to some documents, found by skipping to them."""
        place = np.searchsorted(self.docs, docs)
        place[place == len(self.docs)] = 0
        return np.where(self.docs[place] == docs, self.scores[place], 0) if len(self.docs) else np.zeros(len(docs), np.int64)


def accumulated(lists: list[Postings]) -> Postings:
    """Term at a time: the sums of short lists as one list."""
    if len(lists) == 1:
        return lists[0]
    docs, scores = np.concatenate([p.docs for p in lists]), np.concatenate([p.scores for p in lists])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    return Postings(docs[first], np.add.reduceat(scores, first) if len(first) else scores)


def read_segment(lists: list[Postings], n_docs: int, ids: np.ndarray, best: Best) -> None:
    """Offer ``best`` all documents of a segment that can still be listed."""
    short = [p for p in lists if len(p.docs) <= n_docs * SHORT_SHARE]
    lists = [p for p in lists if len(p.docs) > n_docs * SHORT_SHARE] + ([accumulated(short)] if short else [])
    lists.sort(key=lambda p: p.most)
    reach = np.cumsum([p.most for p in lists]).tolist()  # of a list and all with smaller bounds
    low = 0
    while lists and low < n_docs:
        # Lists that cannot reach the least listed score together name no candidates.
        essential = next((i for i, r in enumerate(reach) if r >= best.least), None)
        if essential is None:
            return
        high = low + RANGE
        cuts = [np.searchsorted(p.docs, (low, high)).tolist() for p in lists[essential:]]
        named = np.concatenate([p.docs[a:b] for p, (a, b) in zip(lists[essential:], cuts, strict=True)])
        if len(named):
            scores = np.concatenate([p.scores[a:b] for p, (a, b) in zip(lists[essential:], cuts, strict=True)])
            total = np.bincount(named - low, minlength=RANGE)
            docs = np.flatnonzero(total) + low
            sums = np.zeros(RANGE, np.int64)
            np.add.at(sums, named - low, scores)
            sums = sums[docs - low]
            for i in range(essential - 1, -1, -1):
                able = sums + reach[i] >= best.least
                docs, sums = docs[able], sums[able]
                if not len(docs):
                    break
                sums = sums + lists[i].at(docs)
            able = sums >= best.least
            if able.any():
                best.offer(ids[docs[able]], sums[able])
        low = high


def read_index(index: DataFrame, queries: Mapping[int, np.ndarray], n: int, total: int, weights: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): what each task lists for the queries (number: term numbers) of a block."""
    shared = index.sparkSession.sparkContext.broadcast((dict(queries), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best = {q: Best(k) for q in asked}
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                ids = (ids.fill_null(_NO_ID) if ids.null_count else ids).to_numpy()
                m = length_norms(unpacked(batch.column("lengths")[row].as_py()), n, total)
                terms = batch.column("terms")[row].values.to_numpy()
                ends = np.cumsum(batch.column("sizes")[row].values.to_numpy())
                docs, tf = unpacked(batch.column("docs")[row].as_py()), unpacked(batch.column("tf")[row].as_py())
                lists = {}
                for t, a, b in zip(terms.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                    if weight[t] > 0:
                        lists[t] = Postings(docs[a:b], contribution(int(weight[t]), tf[a:b], m[docs[a:b]]))
                for q, own in asked.items():
                    read_segment([lists[t] for t in own if t in lists], len(ids), ids, best[q])
        for q, b in best.items():
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(b.ids), pa.int64()), pa.array(b.ids, pa.int64(), mask=b.ids == _NO_ID), pa.array(b.scores)], ["query", "doc_id", "score"])

    return index.mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, ranks from 1.

    Equal scores stand by ascending id, rows without an id behind the others
    of their score; a repeated id is ranked as often as its rows score.  Null
    and empty texts have no terms; an item without terms, and every item of an
    empty corpus, gets no rows.  Items are worked off in blocks of a bounded
    number of bytes, one scan of the documents each; an item that stands
    several times in ``items`` is answered as often.
    """
    spark = docs.sparkSession
    asked = items.select(items[item_col].alias("item_id"), items[item_text].alias("text"))
    kind = asked.schema["item_id"].dataType
    n_bytes = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-n_bytes // BLOCK_BYTES) or 1
    if blocks > 1:  # stored, so that every block sees the same rows
        asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "search-items")
    found = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for block in range(blocks):
        rows = (asked.where(F.col("block") == block) if blocks > 1 else asked).select("item_id", "text").collect()  # about BLOCK_BYTES
        own = {q: sorted(set(terms_of((r["text"] or "").encode()))) for q, r in enumerate(rows)}
        terms = sorted({t for ts in own.values() for t in ts})
        if not terms:
            continue
        number = {t: i for i, t in enumerate(terms)}
        index = segment_index(docs, terms, id_col, text_col)
        n, total, weights = term_weights(index, len(terms))
        listed = read_index(index, {q: np.array([number[t] for t in ts]) for q, ts in own.items() if ts}, n, total, weights, k)
        by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = materialize(listed.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "search-ranked")
        discard(index)
        named = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], T.StructType([T.StructField("query", T.LongType()), T.StructField("item_id", kind)]))
        found = found.unionByName(ranked.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"))
    return found


#: The same in SQL, by summing all postings.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), corpus AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d
), p AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(corpus.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, corpus GROUP BY term
), s AS (
  SELECT item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * corpus.n) // corpus.l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), corpus GROUP BY item_id, doc_id, r
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
