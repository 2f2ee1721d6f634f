"""Media columns stored as content-defined chunks.

A medium (here: mono PCM with 8-bit samples behind a RIFF header) is cut where
a rolling gear hash meets a mask, so that equal stretches give equal chunks
wherever they stand.  Chunks are named by digest.  Digests that occur more than
once are found by a Spark aggregation over digests alone; their bytes go once
into a shared chunk table, while all other chunks stay packed in the row of
their medium.  What a map task knows of the shared digests is a Bloom filter,
sized by their number up to ``MOST_FILTER_BITS``; a false positive only moves a
chunk to the shared table, which all are in the end when the filter is full.
Reading back joins the ordered chunk lists to that table, concatenates, and
verifies the digest of the whole medium.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import as_bytes
from .common import discard, hot_keys, join_spread, materialize

UNIT = 192  # bytes that a payload is a multiple of
HEADER = 44
LEAST, MOST, MASK_BITS = 256, 8192, 10
#: The filter has a power of two of bits, BITS_PER_DIGEST for each digest or little more, and never more than 2 ** MOST_FILTER_BITS (16 MB).
BITS_PER_DIGEST, MOST_FILTER_BITS = 12, 27
_PLACES = 3
_ROWS = 400
#: Digests that a task remembers to have handed over; one that it forgot is handed over again.
_MOST_GIVEN = 200_000


def payload_of(text: bytes) -> bytes:
    """The text padded with blanks to a positive multiple of UNIT."""
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def as_wave(payload: bytes, rate: int = 8000) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def samples_of(wave: bytes) -> bytes:
    size = struct.unpack("<I", wave[40:44])[0]
    if wave[:4] != b"RIFF" or size != len(wave) - HEADER:
        raise ValueError("no 8-bit wave")
    return wave[HEADER:]


_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_MASK = np.uint32(((1 << MASK_BITS) - 1) << (16 - MASK_BITS))


def cut_points(media: bytes) -> list[int]:
    """Ends of the chunks: where the gear hash of the last 16 bytes meets the mask, no chunk under LEAST (but the last) or over MOST bytes."""
    n = len(media)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 bytes
        h[k:] += h[:-k] << np.uint32(k)
    hits = (np.flatnonzero((h & _MASK) == 0) + 1).tolist()
    out, start, i = [], 0, 0
    while n - start > LEAST:
        while i < len(hits) and hits[i] < start + LEAST:
            i += 1
        end = min(hits[i] if i < len(hits) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunked(media: bytes) -> list[bytes]:
    ends = cut_points(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _key(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def filter_bits(n: int) -> int:
    """log2 of the bits of a filter for ``n`` digests."""
    return min(MOST_FILTER_BITS, max(10, (BITS_PER_DIGEST * n - 1).bit_length()))


def describe(wave: bytes) -> tuple[int, str, int, int, str, str]:
    """(payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored bytes."""
    p = samples_of(wave)
    s = np.frombuffer(p, np.uint8).astype(np.int64) - 128
    above = s >= 0
    feature = f"samples={len(s)};peak={int(np.abs(s).max())};mean={s.mean():.6f};rms={float(np.sqrt((s * s).mean())):.6f};crossings={int((above[1:] != above[:-1]).sum())}"
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(wave), hashlib.sha256(wave).hexdigest(), feature


_DESCRIBED = [
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
]


def waves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) for the two passes; null ids and texts are kept."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def shared_filter(texts: DataFrame) -> np.ndarray:
    """Bloom filter of the chunk digests that occur more than once, as 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                found = [digest(c) for t in as_bytes(batch.column("text").slice(at, _ROWS)) for c in chunked(as_wave(payload_of(t)))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(map(_key, found), pa.int64())], ["digest", "key"])

    again = texts.select("text").mapInArrow(run, "digest binary, key bigint").groupBy("digest").agg(F.count("*").alias("n"), F.first("key").alias("key")).where("n > 1")
    again = materialize(again.select("key"), "media-repeated")
    bits = filter_bits(again.count())
    places = [F.shiftrightunsigned("key", 18 * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(_PLACES)]
    words = again.select(F.explode(F.array(*places)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = words.toArrow()  # at most 2 ** (MOST_FILTER_BITS - 6) rows of 16 bytes
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    discard(again)
    return out


def packed_media(texts: DataFrame, words: np.ndarray) -> DataFrame:
    """One row per document: its chunk list, its own chunks' bytes, and the shared chunks that its task meets first."""
    sent = texts.sparkSession.sparkContext.broadcast(words)  # 2 ** (MOST_FILTER_BITS - 3) bytes at most
    last = 64 * len(words) - 1
    chunk = pa.struct([("digest", pa.binary()), ("bytes", pa.binary())])
    item = pa.struct([("digest", pa.binary()), ("size", pa.int64()), ("shared", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, given = sent.value, set()

        def met(d: bytes) -> bool:
            k = _key(d) & 0xFFFFFFFFFFFFFFFF
            return all(int(filled[(p := k >> 18 * i & last) >> 6]) >> (p & 63) & 1 for i in range(_PLACES))

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows: list[list] = [[], [], [], [], []]
                for t in as_bytes(part.column("text")):
                    media = as_wave(payload_of(t))
                    listed, own, shared = [], [], []
                    for c in chunked(media):
                        d = digest(c)
                        both = met(d)
                        listed.append({"digest": d, "size": len(c), "shared": both})
                        if not both:
                            own.append(c)
                        elif d not in given:
                            shared.append({"digest": d, "bytes": c})
                            if len(given) >= _MOST_GIVEN:
                                given.clear()
                            given.add(d)
                    for column, value in zip(rows, (len(t), hashlib.sha256(media).hexdigest(), listed, b"".join(own), shared), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2], pa.list_(item)), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.list_(chunk))],
                    ["doc_id", "n_bytes", "media_sha256", "chunks", "own", "shared"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", texts.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("media_sha256", T.StringType()),
            T.StructField("chunks", T.ArrayType(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("shared", T.BooleanType())]))),
            T.StructField("own", T.BinaryType()),
            T.StructField("shared", T.ArrayType(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("bytes", T.BinaryType())]))),
        ]
    )
    return texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()).withColumn("whole", ~F.exists("chunks", lambda c: c["shared"]))


def rebuilt(chunks: list[dict], own: bytes, shared: dict[bytes, bytes]) -> bytes:
    """The medium from its ordered chunk list."""
    out, at = [], 0
    for c in chunks:
        if c["shared"]:
            out.append(shared[c["digest"]])
        else:
            out.append(own[at : at + c["size"]])
            at += c["size"]
    return b"".join(out)


def read_back(packs: DataFrame, key: str) -> DataFrame:
    """(key, described columns) from rows (key, media_sha256, chunks, own, shared); raises where a medium is not what was stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = []
                for r in part.select(["media_sha256", "chunks", "own", "shared"]).to_pylist():
                    seen = describe(rebuilt(r["chunks"], r["own"], {c["digest"]: c["bytes"] for c in r["shared"] or ()}))
                    if seen[4] != r["media_sha256"]:
                        raise ValueError(f"medium {r['media_sha256']} does not read back")
                    found.append(seen)
                columns = [pa.array([f[i] for f in found], pa.string() if i in (1, 4, 5) else pa.int64()) for i in range(6)]
                yield pa.RecordBatch.from_arrays([part.column(key), *columns], [key, *[f.name for f in _DESCRIBED]])

    return packs.select(key, "media_sha256", "chunks", "own", "shared").mapInArrow(run, T.StructType([packs.schema[key], *_DESCRIBED]))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(media table, shared chunk table), both written to the shared folder."""
    texts = waves(docs, id_col, text_col)
    packs = materialize(packed_media(texts, shared_filter(texts)), "media-packs")
    shared = packs.select(F.explode("shared").alias("c")).select("c.digest", "c.bytes").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    return packs, materialize(shared, "media-chunks")


def read_media(packs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, described columns) of every document, from stored bytes.

    Null and empty texts are media of UNIT blanks.  Equal texts share all
    chunks and are read once; an empty table gives an empty result.
    """
    columns = [f.name for f in _DESCRIBED]
    alone = packs.where("whole").withColumn("doc", F.struct("doc_id", "n_bytes"))
    direct = read_back(alone, "doc").select("doc.*", *columns)
    some = packs.where("NOT whole")
    once = some.groupBy("media_sha256").agg(F.min("row").alias("row"), F.min_by("chunks", "row").alias("chunks"))
    wanted = once.select("row", F.explode("chunks").alias("c")).where("c.shared").select("row", "c.digest").distinct()
    fetched = join_spread(wanted, chunks, "digest", hot_keys(wanted, "digest")).groupBy("row").agg(F.collect_list(F.struct("digest", "bytes")).alias("shared"))
    joined = some.drop("shared").join(fetched, "row")
    described = read_back(joined, "row").drop("row")
    copies = some.select("doc_id", "n_bytes", "row", "media_sha256")
    met = join_spread(copies, described, "media_sha256", hot_keys(copies, "media_sha256"))
    return direct.unionByName(met.select("doc_id", "n_bytes", *columns))
