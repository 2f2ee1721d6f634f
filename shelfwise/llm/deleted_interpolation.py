"""Deleted interpolation: word bigrams scored by maximum-likelihood estimates mixed per context frequency.

    P(w | h) = l2[b] c(h, w) / c(h) + l1[b] c(w) / N + l0[b] / (V + 1),   b = bucket of c(h)

The weights are learned by expectation-maximisation on counts of training
documents that were left out of the estimates (a fixed share of them), then
applied to the counts of all training documents.

Text is moved once.  Documents are packed into compressed chunks and stored;
each chunk sends, for every hash range, one row with its distinct unigram and
bigram keys and their counts; each range sums them and sends the totals back to
the chunks in the order of their keys.  So a key that stands in every document
costs a range one number per chunk, and no row per word is ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import as_bytes
from .common import crc_class, materialize

CHUNK_BYTES = 12_000_000  # text in one chunk, unless a single document is longer
BUCKETS = 16  # contexts seen 0, 1-2, 3-6, 7-14, ... times
#: Hash ranges per order are at most 2 ** this, so that what chunks send grows with their number alone.
MOST_RANGE_BITS = 12
HELD_OUT_SHARE = 10  # one training document in so many is left out for the weights
_CELLS = 48  # steps of a factor of 2 ** 0.5 in which held-out events are gathered
_END, _START = 0, 1  # numbers of the text end and of the context before the first word
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pack(parts: list[bytes]) -> bytes:
    """Strings behind their lengths, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = (8 * (n + 1) + np.cumsum(np.frombuffer(raw, np.int64, n, 8))).tolist()
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends], ends, strict=False)]


def _shut(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.astype(np.int64).tobytes())


def _open(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.int64)


def packed_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (ids, classes, texts, n): some documents of one task; class 0 trains, 1 is left out for the weights, 2 is only scored."""
    five = crc_class(docs[id_col])
    part = F.when(five == 1, 2).when(F.pmod(F.xxhash64(docs[id_col]), F.lit(HELD_OUT_SHARE)) == 0, 1).otherwise(0).cast("int")
    wanted = docs.select(docs[id_col].alias("doc_id"), part.alias("class"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(wanted.schema["doc_id"].dataType)), T.StructField("classes", T.ArrayType(T.IntegerType())), T.StructField("texts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, classes, texts, size, kind = [], [], [], 0, pa.int64()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([classes], pa.list_(pa.int32())), pa.array([_pack(texts)], pa.binary())], schema.names)

        for batch in batches:
            kind = batch.column("doc_id").type
            for i, c, t in zip(batch.column("doc_id").to_pylist(), batch.column("class").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if texts and size + len(t) > CHUNK_BYTES:
                    yield out()
                    ids, classes, texts, size = [], [], [], 0
                ids.append(i)
                classes.append(c)
                texts.append(t.lower())  # of bytes: A-Z only
                size += len(t)
        if texts:
            yield out()

    return wanted.mapInArrow(run, schema).withColumn("chunk", F.monotonically_increasing_id())


class Keys:
    """Word numbers, key hashes and n-grams of a chunk; the same each time a chunk is read."""

    def __init__(self, texts: list[bytes]):
        numbers: dict[bytes, int] = {}
        new = count(2)
        parts, self.lengths = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            words = t.split()
            for w in words:
                if w not in numbers:
                    numbers[w] = next(new)
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            parts.append(np.array([_END], np.int32))
            self.lengths[i] = len(words) + 1
        self.tokens = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.context = np.roll(self.tokens, 1)
        self.context[self.starts] = _START
        h = np.empty(len(numbers) + 2, np.uint64)
        h[_END], h[_START] = xxhash.xxh3_64_intdigest(b"\n"), xxhash.xxh3_64_intdigest(b"\n\n")  # no word holds a blank
        h[2:] = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
        self.n_words = len(h)
        two = (h[self.context] * _K1 + h[self.tokens]) * _K2
        two ^= two >> np.uint64(29)
        self.single, self.word_at = np.unique(h, return_inverse=True)
        self.pairs, self.pair_at = np.unique(two, return_inverse=True)

    def tallies(self, classes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(order, keys, counts in training documents, counts in left-out ones)."""
        c = np.repeat(classes, self.lengths)
        train, held = c < 2, c == 1
        out = []
        for order, keys, at in ((1, self.single, self.word_at[self.tokens]), (2, self.pairs, self.pair_at)):
            one, two = np.bincount(at[train], minlength=len(keys)), np.bincount(at[held], minlength=len(keys))
            if order == 1:  # the context before a text's first word occurs once a text
                first = self.word_at[_START]
                one[first] += int((classes < 2).sum())
                two[first] += int((classes == 1).sum())
            out.append((order, keys, one, two))
        return out


_SENT = "span bigint, place bigint, chunk bigint, keys binary, train binary, held binary"


def sent_counts(chunks: DataFrame, bits: int) -> DataFrame:
    """One row per chunk and hash range (the leading ``bits`` of a key; unigrams apart from bigrams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, classes, blob in zip(batch.column("chunk").to_pylist(), batch.column("classes").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                rows: list[list] = [[], [], [], [], [], []]
                for order, keys, train, held in Keys(_unpack(blob)).tallies(np.array(classes, np.int64)):
                    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    ends = np.searchsorted(ranges, np.arange(1 << bits), side="right")
                    a = 0
                    for r, b in enumerate(ends.tolist()):
                        if b > a:
                            for column, value in zip(rows, (order, r, chunk, keys[a:b].tobytes(), _shut(train[a:b]), _shut(held[a:b])), strict=True):
                                column.append(value)
                        a = b
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["span", "place", "chunk", "keys", "train", "held"])

    return chunks.select("chunk", "classes", "texts").mapInArrow(run, _SENT)


def summed_counts(sent: DataFrame) -> DataFrame:
    """Totals of each range back to the chunks that asked, in the order of their keys; rows of chunk -1 hold the range's own sums."""

    def run(table: pa.Table) -> pa.Table:
        chunk, span, place = table.column("chunk").to_pylist(), table.column("span")[0].as_py(), table.column("place")[0].as_py()
        keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        train, held = (np.bincount(at, np.concatenate([_open(b) for b in table.column(c).to_pylist()]), len(every)).astype(np.int64) for c in ("train", "held"))
        if span == 1:
            own = ~np.isin(every, np.array([xxhash.xxh3_64_intdigest(b"\n\n")], np.uint64))
            stats = [int(train[own].sum()), int((train[own] > 0).sum()), int((train - held)[own].sum()), int(((train - held)[own] > 0).sum())]
        else:
            stats = [0, 0, 0, 0]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        back = [(_shut(train[at[a:b]]), _shut(held[at[a:b]])) for a, b in zip([0, *ends], ends, strict=False)]
        n = len(chunk)
        return pa.table(
            {
                "chunk": pa.array([*chunk, -1], pa.int64()), "span": pa.array([span] * (n + 1), pa.int64()), "place": pa.array([place] * (n + 1), pa.int64()),
                "train": pa.array([*(b[0] for b in back), b""], pa.binary()), "held": pa.array([*(b[1] for b in back), b""], pa.binary()),
                **{k: pa.array([0] * n + [v], pa.int64()) for k, v in zip(("n", "v", "n_kept", "v_kept"), stats, strict=True)},
            }
        )

    return sent.groupBy("span", "place").applyInArrow(run, "chunk bigint, span bigint, place bigint, train binary, held binary, n bigint, v bigint, n_kept bigint, v_kept bigint")


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 0) + 1.0).astype(np.int64), BUCKETS - 1)


def _chunk_counts(back: pa.Table, keys: Keys) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """([unigram, bigram] counts in training documents, and in left-out ones), by key of the chunk."""
    rows = sorted(zip(back.column("span").to_pylist(), back.column("place").to_pylist(), back.column("train").to_pylist(), back.column("held").to_pylist(), strict=True))
    out: list[list[np.ndarray]] = [[], []]
    for order in (1, 2):
        for k in (0, 1):
            out[k].append(np.concatenate([_open(r[2 + k]) for r in rows if r[0] == order]))
    return out[0], out[1]


def _estimates(keys: Keys, one: np.ndarray, two: np.ndarray, n: int, pick: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, bigram estimate, unigram estimate) at each token."""
    word = one[keys.word_at]
    before = word[keys.context[pick]]
    return _bucket(before), two[keys.pair_at[pick]] / np.maximum(before, 1), word[keys.tokens[pick]] / max(n, 1)


def _cell(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(np.floor(-2 * np.log2(np.maximum(p, 1e-300))), 0, _CELLS - 2) + 1, 0).astype(np.int64)


def held_out_events(chunks: DataFrame, back: DataFrame, n_kept: int) -> list[tuple[int, float, float, int]]:
    """(bucket, mean bigram estimate, mean unigram estimate, events): left-out tokens gathered in at most BUCKETS * 48 * 48 cells."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        for classes, blob in zip(left.column("classes").to_pylist(), left.column("texts").to_pylist(), strict=True):
            keys = Keys(_unpack(blob))
            all_, held = _chunk_counts(right, keys)
            pick = np.flatnonzero(np.repeat(np.array(classes), keys.lengths) == 1)
            if len(pick):
                b, p2, p1 = _estimates(keys, all_[0] - held[0], all_[1] - held[1], n_kept, pick)
                cell, at = np.unique((b * _CELLS + _cell(p2)) * _CELLS + _cell(p1), return_inverse=True)
                found.append(np.stack([cell, np.bincount(at), np.bincount(at, p2), np.bincount(at, p1)], 1))
        rows = np.concatenate(found) if found else np.zeros((0, 4))
        return pa.table({"cell": pa.array(rows[:, 0].astype(np.int64)), "events": pa.array(rows[:, 1].astype(np.int64)), "p2": pa.array(rows[:, 2]), "p1": pa.array(rows[:, 3])})

    some = chunks.where(F.array_contains("classes", 1)).groupBy("chunk").cogroup(back.where("chunk >= 0").groupBy("chunk")).applyInArrow(run, "cell bigint, events bigint, p2 double, p1 double")
    rows = some.groupBy("cell").agg(F.sum("events").alias("events"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).collect()
    return sorted((r["cell"] // _CELLS**2, r["p2"] / r["events"], r["p1"] / r["events"], r["events"]) for r in rows)


def mixture_weights(events: list[tuple[int, float, float, int]], v_kept: int, rounds: int = 60) -> np.ndarray:
    """Weights (BUCKETS, 3) of the bigram, unigram and uniform estimates by expectation-maximisation.

    A bucket starts from the pooled weights of all buckets and keeps them where it has no events.
    """
    start = np.array([0.3, 0.6, 0.1])
    if not events:
        out = np.tile(start, (BUCKETS, 1))
        out[0] = [0.0, 0.85, 0.15]
        return out
    e = np.array(events)
    p = np.stack([e[:, 1], e[:, 2], np.full(len(e), 1 / (v_kept + 1))], 1)

    def fit(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        n = e[rows, 3][:, None]
        for _ in range(rounds):
            share = p[rows] * w
            w = (n * share / share.sum(1, keepdims=True)).sum(0) + 1e-3
            w /= w.sum()
        return w

    pooled = fit(np.arange(len(e)), start)
    out = np.stack([fit(r, pooled) if len(r := np.flatnonzero(e[:, 0] == b)) else pooled for b in range(BUCKETS)])
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]  # a context never seen has no bigrams
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null and empty texts are one token, the text end.  held_out rows (crc32 of
    the id modulo 5 is 1; a null id counts as the empty text) are never learned
    from.  Without any training document all probabilities are uniform.
    Repeated rows are learned from as often as they stand there and scored
    alike; an empty table gives an empty result.
    """
    chunks = materialize(packed_chunks(docs, id_col, text_col), "lm-chunks")
    n_chunks = chunks.count()
    bits = min(MOST_RANGE_BITS, math.ceil(math.log2(max(1, n_chunks) * 2)))
    back = materialize(summed_counts(sent_counts(chunks, bits)), "lm-counts")
    total = back.where("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_kept", "v_kept")]).first()
    n, v, n_kept, v_kept = total["n"], total["v"], total["n_kept"], total["v_kept"]
    weights = mixture_weights(held_out_events(chunks, back, n_kept), v_kept)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
        ]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for ids, classes, blob in zip(left.column("ids"), left.column("classes").to_pylist(), left.column("texts").to_pylist(), strict=True):
            keys = Keys(_unpack(blob))
            (one, two), _ = _chunk_counts(right, keys)
            c = one[keys.word_at][keys.tokens]
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            b, p2, p1 = _estimates(keys, one, two, n)
            w = weights[b]
            own = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1)) if n else np.full(len(c), -math.log10(v + 1) if v else 0.0)
            sums = lambda a: np.add.reduceat(a, keys.starts)  # noqa: E731, B023
            k = len(keys.lengths)
            out.append(
                pa.table(
                    [ids.values, pa.array(np.array(classes) == 2), pa.array(keys.lengths), pa.array(sums((c > 0).astype(np.int64))), pa.array(np.full(k, n, np.int64)), pa.array(sums(base)), pa.array(sums(own))],
                    schema.names,
                )
            )
        return pa.concat_tables(out) if out else pa.table([pa.array([], f) for f in (left.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], schema.names)

    return chunks.groupBy("chunk").cogroup(back.where("chunk >= 0").groupBy("chunk")).applyInArrow(run, schema)
