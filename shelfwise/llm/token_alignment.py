"""Alignment of two tokenizers' tokens on the same bytes, with corpus-wide link counts.

Two tokens of a text are linked where their byte ranges overlap; where tokens
of both sides end together a group ends.  How often each pair of ids is linked
in the whole corpus is counted outside memory:

* Tasks align their documents and gather records (pair, document, links) into
  runs of bounded size, sorted side-major: by the second side's id, then the
  first's, then document.  A run is cut into radix partitions of the second
  side's ids and kept as zstandard columns in a written table.
* The runs of a partition are merged through a heap, frame by frame, and each
  pair's links are summed.  Where a partition has more runs than a task should
  merge it is dealt out in parts, whose sums Spark adds up.
* Read side-major the summed pairs give each id's highest count as soon as the
  id changes; they are packed into frames and meet the same runs again, now
  with their documents, and what every record adds to its document streams
  back, one row per run and partition.

What a task holds is one run's records, or the frames of one partition's
pairs, which the two vocabularies bound, never all records of a pair.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, prefix_table
from .bpe import as_bytes, slices
from .common import materialize

#: Radix partitions; bytes of text and documents of a run; runs that one task merges; pairs of a frame.
PARTITIONS, RUN_BYTES, RUN_DOCS, RUNS_A_TASK, FRAME = 32, 8_000_000, 60_000, 64, 65_536
_CACHE_BYTES = 40_000_000
_MEASURES = ("n_a", "n_b", "n_groups", "n_links")


class Sides:
    """Both encoders, the lengths of their tokens, and the spelling of ids in groups."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.a = bpe.ForcedBoundaryBPE(byte_vocabulary, _CACHE_BYTES)
        self.a.splitter = None  # special tokens spelt out in a text are text
        self.b = prefix_table.PrefixTable(piece_model, _CACHE_BYTES)
        self.bytes_a, self.bytes_b = self.a.tokens.bytes, self.b.pieces.bytes
        self.length_a, self.length_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        ends = [(self.n_a, b","), (self.n_a, b"|"), (self.n_b, b","), (self.n_b, b";")]
        self.spelt = np.array([b"%d%b" % (i, end) for n, end in ends for i in range(n)], object)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts) of both sides; a text whose tokens on a side are not a blank and the text has none.

        Tokens spell what was encoded, but for a sign that side b takes for a
        blank; where one was left out the lengths tell.
        """
        sign = prefix_table.BLANK_SIGN.encode()
        texts = [b"" if sign in t else t for t in texts]
        while True:
            a, n_a = self.a.encode_batch([b" " + t if t else t for t in texts])
            b, n_b = self.b.encode_batch(texts)
            want = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
            wrong = np.flatnonzero((self.spelt_bytes(self.length_a[a], n_a) != want) | (self.spelt_bytes(self.length_b[b], n_b) != want))
            if not len(wrong):
                return a, n_a, b, n_b
            for k in wrong.tolist():
                texts[k] = b""

    @staticmethod
    def spelt_bytes(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bytes of each text's tokens."""
        return np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)], prepend=0)


@lru_cache(1)
def sides(byte_vocabulary: str, piece_model: str) -> Sides:
    """One pair of encoders per worker process."""
    return Sides(byte_vocabulary, piece_model)


class Aligned:
    """Tokens of several texts laid on one line of bytes, one text after another."""

    def __init__(self, s: Sides, texts: list[bytes]):
        self.s = s
        a, self.n_a, b, self.n_b = s.encode(texts)
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        self.end_a, self.end_b = np.cumsum(s.length_a[self.a]), np.cumsum(s.length_b[self.b])
        size = int(self.end_a[-1]) + 1 if len(self.a) else 1
        self.ends_a, self.ends_b = np.zeros(size, bool), np.zeros(size, bool)
        self.ends_a[self.end_a] = self.ends_b[self.end_b] = True
        self.done_a, self.done_b = np.cumsum(self.ends_a), np.cumsum(self.ends_b)
        self.both = self.ends_a & self.ends_b
        self.group_ends = np.flatnonzero(self.both)
        # Every stretch between neighbouring ends lies in one token of each side: a link.
        self.link_ends = np.flatnonzero(self.ends_a | self.ends_b)
        self.text_ends = np.concatenate([[0], self.end_a])[np.cumsum(self.n_a)]

    def per_text(self, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(ends, self.text_ends, side="right"), prepend=0)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, text) of every link."""
        at = self.link_ends
        a = self.a[self.done_a[at] - self.ends_a[at]]
        b = self.b[self.done_b[at] - self.ends_b[at]]
        return a, b, np.repeat(np.arange(len(self.n_a)), self.per_text(at))

    def groups(self) -> list[bytes]:
        """Each text's groups, a1,a2|b1;a3|b2,b3 in decimal ids."""
        done = np.cumsum(self.both)
        of_a, of_b = done[self.end_a] - self.both[self.end_a], done[self.end_b] - self.both[self.end_b]
        b_before = np.concatenate([[0], self.done_b[self.group_ends]])
        a_until = self.done_a[self.group_ends]
        line = np.empty(len(self.a) + len(self.b), np.int64)
        n_a, n_b = self.s.n_a, self.s.n_b
        line[np.arange(len(self.a)) + b_before[of_a]] = self.a + n_a * self.both[self.end_a]
        line[np.arange(len(self.b)) + a_until[of_b]] = self.b + n_b * self.both[self.end_b] + 2 * n_a
        words = self.s.spelt[line].tolist()
        at = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return [b"".join(words[x:y])[:-1] for x, y in zip(at, at[1:], strict=False)]


# Runs ---------------------------------------------------------------------------


def packed(values: np.ndarray, kind: type) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind).astype(np.int64)


class Run:
    """Records (pair, document, links) of one run, and its documents' own columns."""

    def __init__(self, number: int):
        self.number, self.bytes, self.docs, self.records = number, 0, 0, []

    def add(self, pairs: np.ndarray, texts: np.ndarray, n_texts: int, n_bytes: int) -> None:
        seen, links = np.unique(pairs * n_texts + texts, return_counts=True)
        self.records.append((seen // n_texts, seen % n_texts + self.docs, links))
        self.docs += n_texts
        self.bytes += n_bytes

    def partitions(self, n_a: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
        """(partition, pairs, links of a pair, documents of a pair, documents, links of a document) of each partition that has records."""
        if not self.records:
            return
        pair, doc, links = (np.concatenate(c) for c in zip(*self.records, strict=True))
        part = pair // n_a % PARTITIONS
        order = np.lexsort((doc, pair, part))
        pair, doc, links, part = pair[order], doc[order], links[order], part[order]
        cuts = np.searchsorted(part, np.arange(PARTITIONS + 1))
        for p in range(PARTITIONS):
            x, y = cuts[p], cuts[p + 1]
            if x < y:
                first = np.flatnonzero(np.diff(pair[x:y], prepend=-1))
                held = np.diff(np.append(first, y - x))
                keys = pair[x:y][first]
                yield p, packed(np.diff(keys, prepend=0), np.uint64), packed(np.add.reduceat(links[x:y], first), np.uint64), packed(held, np.uint32), packed(doc[x:y], np.uint16), packed(links[x:y], np.uint32)


def merged_runs(runs: Iterable[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, links) in ascending order, each pair once, of runs of ascending frames.

    The heap holds the last pair of every run's frame; up to the least of them
    all runs' pairs are known and can be summed.
    """
    runs = [iter(r) for r in runs]
    heap: list[tuple[int, int]] = []
    frames: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fetch(i: int) -> None:
        for keys, links in runs[i]:
            if len(keys):
                frames[i] = keys, links
                heapq.heappush(heap, (int(keys[-1]), i))
                return

    for i in range(len(runs)):
        fetch(i)
    while heap:
        limit, parts = heap[0][0], []
        for i, (keys, links) in frames.items():
            cut = np.searchsorted(keys, limit, side="right")
            if cut:
                parts.append((keys[:cut], links[:cut]))
                frames[i] = keys[cut:], links[cut:]
        while heap and heap[0][0] == limit:
            i = heapq.heappop(heap)[1]
            del frames[i]
            fetch(i)
        keys, links = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], links[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[first], np.add.reduceat(links, first)


def frames_of(pairs: bytes, links: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A run's pairs and their links, frame by frame."""
    keys, n = np.cumsum(unpacked(pairs, np.uint64)), unpacked(links, np.uint64)
    for at in range(0, len(keys), FRAME):
        yield keys[at : at + FRAME], n[at : at + FRAME]


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of batches that are sorted by ``keys``, as (key, rows) one key at a time."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield from batch.slice(at, 64).to_pylist()

    return groupby(rows(), key=lambda r: tuple(r[k] for k in keys))


# Stages --------------------------------------------------------------------------


def written_runs(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: runs cut into partitions (part, pairs, ...), and documents (place, doc_id, measures, groups_sha256)."""
    wanted = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    binary = ("pairs", "pair_links", "held", "docs", "links")
    schema = T.StructType(
        [T.StructField("run", T.LongType()), T.StructField("part", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in binary)]
        + [T.StructField("place", T.IntegerType()), T.StructField("doc_id", wanted.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in _MEASURES), T.StructField("groups_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(byte_vocabulary, piece_model)
        number = TaskContext.get().partitionId() << 32
        now = Run(number)

        def closed() -> pa.RecordBatch:
            rows = list(now.partitions(s.n_a))
            own = list(zip(*rows, strict=True)) if rows else [()] * 6
            n = len(rows)
            kinds = [pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays(
                [pa.array([now.number] * n, pa.int64()), *(pa.array(c, k) for c, k in zip(own, kinds, strict=True)), pa.nulls(n, pa.int32()), pa.nulls(n, doc_kind), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.string())],
                schema.names,
            )

        doc_kind = None
        for batch in batches:
            doc_kind = batch.schema.field("doc_id").type
            for long in slices(batch):
                for at in range(0, long.num_rows, RUN_DOCS // 4):
                    part = long.slice(at, RUN_DOCS // 4)
                    if now.bytes > RUN_BYTES or now.docs + part.num_rows > RUN_DOCS:
                        yield closed()
                        now = Run(now.number + 1)
                    texts = as_bytes(part.column("text"))
                    x, n = Aligned(s, texts), part.num_rows
                    a, b, of = x.links()
                    places = pa.array(np.arange(now.docs, now.docs + n), pa.int32())
                    now.add(b * s.n_a + a, of, n, sum(map(len, texts)))
                    digests = [hashlib.sha256(g).hexdigest() if g else "" for g in x.groups()]
                    measures = [pa.array(m, pa.int64()) for m in (x.n_a, x.n_b, x.per_text(x.group_ends), x.per_text(x.link_ends))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([now.number] * n, pa.int64()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 5, places, part.column("doc_id"), *measures, pa.array(digests, pa.string())], schema.names
                    )
        if doc_kind is not None:
            yield closed()

    return materialize(wanted.mapInArrow(run, schema), "alignment-runs")


def pair_counts(runs: DataFrame) -> DataFrame:
    """(pair, count): links of every pair in all runs (part, deal, run, pairs, pair_links)."""
    dealt = runs.select("part", "deal", "pairs", "pair_links").repartition("part", "deal").sortWithinPartitions("part", "deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, ("part", "deal")):
            for keys, links in merged_runs([frames_of(r["pairs"], r["pair_links"]) for r in rows]):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(links)], ["pair", "count"])

    return dealt.mapInArrow(run, "pair bigint, count bigint").groupBy("pair").agg(F.sum("count").alias("count"))


def counted_frames(counts: DataFrame, n_a: int) -> DataFrame:
    """(part, frame, pairs, counts, best) in side-major order: the pairs of a partition, and whether each is its second id's highest."""
    part = F.pmod(F.floor(F.col("pair") / n_a), F.lit(PARTITIONS)).cast("int")
    dealt = counts.withColumn("part", part).repartition("part").sortWithinPartitions("part", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_part, frame, keys, counts = None, 0, np.empty(0, np.int64), np.empty(0, np.int64)

        def closed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.diff(keys // n_a, prepend=-1))
            most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(keys))))
            blobs = [packed(np.diff(keys, prepend=0), np.uint64), packed(counts, np.uint64), packed(counts == most, np.uint8)]
            return pa.RecordBatch.from_arrays([pa.array([open_part], pa.int32()), pa.array([frame], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], ["part", "frame", "pairs", "counts", "best"])

        for batch in batches:
            part, pair, count = (batch.column(c).to_numpy() for c in ("part", "pair", "count"))
            for p in np.unique(part).tolist():
                if p != open_part:
                    if len(keys):
                        yield closed(keys, counts)
                    open_part, frame, keys, counts = p, 0, np.empty(0, np.int64), np.empty(0, np.int64)
                keys, counts = np.append(keys, pair[part == p]), np.append(counts, count[part == p])
                if len(keys) > FRAME:
                    # the last id's pairs may go on
                    cut = int(np.searchsorted(keys, keys[-1] // n_a * n_a))
                    if cut:
                        yield closed(keys[:cut], counts[:cut])
                        frame, keys, counts = frame + 1, keys[cut:], counts[cut:]
        if len(keys):
            yield closed(keys, counts)

    return dealt.mapInArrow(run, "part int, frame bigint, pairs binary, counts binary, best binary")


def contributions(runs: DataFrame, frames: DataFrame, deals: int) -> DataFrame:
    """(run, n_best, count_sum): per run and partition, what its records add to each of the run's documents, packed in order of their places."""
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    own = runs.select("part", "deal", F.lit(1).alias("kind"), F.col("run").alias("nth"), "pairs", "held", "docs", "links", *none("counts", "best"))
    every = F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal")
    spread = frames.select("part", every, F.lit(0).alias("kind"), F.col("frame").alias("nth"), "pairs", *none("held", "docs", "links"), "counts", "best")
    dealt = spread.unionByName(own).repartition("part", "deal").sortWithinPartitions("part", "deal", "kind", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, ("part", "deal")):
            known: list[tuple[np.ndarray, ...]] = []
            keys = None
            for r in rows:
                pairs = np.cumsum(unpacked(r["pairs"], np.uint64))
                if r["kind"] == 0:
                    known.append((pairs, unpacked(r["counts"], np.uint64), unpacked(r["best"], np.uint8)))
                    continue
                if keys is None:
                    keys, counts, best = (np.concatenate(c) for c in zip(*known, strict=True))
                at = np.repeat(np.searchsorted(keys, pairs), unpacked(r["held"], np.uint32))
                docs, links = unpacked(r["docs"], np.uint16), unpacked(r["links"], np.uint32)
                n_best, total = np.zeros(docs.max() + 1, np.int64), np.zeros(docs.max() + 1, np.int64)
                np.add.at(n_best, docs, links * best[at])
                np.add.at(total, docs, links * counts[at])
                yield pa.RecordBatch.from_arrays([pa.array([r["nth"]], pa.int64()), pa.array([packed(n_best, np.uint64)], pa.binary()), pa.array([packed(total, np.uint64)], pa.binary())], ["run", "n_best", "count_sum"])

    return dealt.mapInArrow(run, "run bigint, n_best binary, count_sum binary")


def align_tokens(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Side a is a byte-level vocabulary of the tokenizers library and reads a
    blank and the text, side b a model of the sentencepiece library, which
    puts that blank itself.  Null and empty texts, and those whose tokens'
    bytes are not a blank and the text, have no tokens: zeros and an empty
    groups_sha256.  Repeated rows count and come back as often as they are; an
    empty table gives an empty result.
    """
    table = written_runs(docs, byte_vocabulary, piece_model, id_col, text_col)
    n_a = len(bpe.tokens(byte_vocabulary).bytes)
    runs = table.where(F.col("part").isNotNull())
    deals = max(1, -(-runs.select("run").distinct().count() // RUNS_A_TASK))
    runs = runs.withColumn("deal", F.pmod(F.xxhash64("run"), F.lit(deals)).cast("int"))
    added = contributions(runs, counted_frames(pair_counts(runs), n_a), deals)
    own = table.where(F.col("part").isNull()).select("run", F.lit(1).alias("kind"), "place", "doc_id", *_MEASURES, "groups_sha256", *(F.lit(None).cast("binary").alias(c) for c in ("n_best", "count_sum")))
    schema = T.StructType([table.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in (*_MEASURES, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])
    empty = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in ("place", "doc_id", *_MEASURES, "groups_sha256")]
    met = added.select("run", F.lit(0).alias("kind"), *empty, "n_best", "count_sum").unionByName(own).repartition("run").sortWithinPartitions("run", "kind", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, total = None, np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, np.int64)
        for batch in batches:
            numbers, kinds = batch.column("run").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(numbers)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if numbers[x] != at:
                    at = numbers[x]
                    best[:], total[:] = 0, 0
                part = batch.slice(x, y - x)
                if kinds[x] == 0:
                    for into, column in ((best, "n_best"), (total, "count_sum")):
                        for blob in part.column(column):
                            values = unpacked(blob.as_py(), np.uint64)
                            into[: len(values)] += values
                else:
                    places = part.column("place").to_numpy()
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in _MEASURES), pa.array(best[places]), pa.array(total[places]), part.column("groups_sha256")], schema.names)

    return met.mapInArrow(run, schema)


def token_groups(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups) of every row: the groups themselves, a1,a2|b1;a3|b2,b3; empty where ``align_tokens`` finds no tokens."""
    wanted = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("doc_id", wanted.schema["doc_id"].dataType), T.StructField("groups", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(byte_vocabulary, piece_model)
        for batch in batches:
            for part in slices(batch):
                groups = Aligned(s, as_bytes(part.column("text"))).groups()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g.decode() for g in groups], pa.string())], schema.names)

    return wanted.mapInArrow(run, schema)
