"""BPE encoding and decoding by forced-boundary splitting.

Two bytes that never stand next to each other inside any vocabulary token are
a certain cut: no merge can cross it.  A text is cut at all such places at
once (one table look-up per byte), the fragments, most of which recur, are
encoded independently of each other, and their ids are joined in order.
Python works on Arrow batches inside Spark tasks, in slices of about a
megabyte of text; a worker keeps a table of fragments it has met, bounded by
bytes.  ``code_documents`` encodes and decodes in one pass.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Unicode's White_Space (fixed value).
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: How byte-level vocabularies split text before merging (fixed value), with White_Space spelled out for \s.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s", f"[^{BLANK}").replace(r"\s", f"[{BLANK}]").replace(r"\S", f"[^{BLANK}]")

# Two bytes that UTF-8 never uses: between fragments, and between texts.
_SEPARATOR, _TEXT_END = 0xFF, 0xFE
#: Bytes of the fragments that a worker remembers, with what Python keeps for each beside its own.
MOST_BYTES, _FRAGMENT_BYTES = 48_000_000, 120
SLICE_BYTES = 1_000_000


@lru_cache(1)
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from code point 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokens:
    """The byte strings that the ids of a byte-level vocabulary file stand for; all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(back.__getitem__, token))
        self.plain = sorted(vocab.values())
        for token, i in self.special.items():
            self.bytes[i] = token

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class ForcedBoundaryBPE:
    """Encoder of one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str, most_bytes: int = MOST_BYTES):
        from tokenizers import Tokenizer

        self.merges = Tokenizer.from_file(path).model
        self.tokens = tokens(path)
        self.letters = [byte_alphabet()[b] for b in range(256)]
        self.special = self.tokens.special
        joined = np.zeros(65536, bool)
        for i in self.tokens.plain:
            raw = self.tokens.bytes[i]
            for a, b in zip(raw, raw[1:], strict=False):
                joined[a << 8 | b] = True
        self.forced = ~joined
        # Not between the bytes of one character; and before an apostrophe only where
        # what stands on its left cannot change how the apostrophe is read.
        pair = np.arange(65536)
        left, right = pair >> 8, pair & 255
        self.forced &= (right & 0xC0) != 0x80
        plain = ((left >= 48) & (left <= 57)) | ((left >= 65) & (left <= 90)) | ((left >= 97) & (left <= 122)) | (left == 10)
        self.forced &= (right != 39) | plain
        self.forced |= (left == _TEXT_END) | (right == _TEXT_END)
        # Bytes that may end a blank, and those before them where more than one byte makes it.
        self.blank_end, self.blank_mid = np.zeros(256, bool), np.zeros(256, bool)
        for c in BLANK:
            raw = c.encode()
            self.blank_end[raw[-1]] = True
            if len(raw) > 1:
                self.blank_mid[raw[-2]] = True
        self.pattern = regex.compile(PRE_TOKEN)
        self.splitter = regex.compile(b"(" + b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.most = most_bytes
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.seen: dict[bytes, int] = {b"\xfe": 0}
        self.starts, self.lengths, self.flat = array("q", [0, 0]), array("q", [0]), array("i")

    def _merge(self, piece: str) -> list[int]:
        return [t.id for t in self.merges.tokenize("".join(map(self.letters.__getitem__, piece.encode())))]

    def _encode_fragment(self, fragment: bytes) -> list[int]:
        """Ids of a fragment; a trailing separator byte says that other text than a blank follows."""
        followed = fragment[-1] == _SEPARATOR
        text = (fragment[:-1] if followed else fragment).decode()
        ids: list[int] = []
        if followed and text[-1] in BLANK and len(text) > 1:
            for p in self.pattern.findall(text[:-1]):
                ids += self._merge(p)
            return ids + self._merge(text[-1])
        for p in self.pattern.findall(text):
            ids += self._merge(p)
        return ids

    def _number(self, fragment: bytes) -> int:
        ids = self._encode_fragment(fragment)
        self.seen[fragment] = n = len(self.lengths)
        self.lengths.append(len(ids))
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        self.held += _FRAGMENT_BYTES + len(fragment) + 4 * len(ids)
        return n

    def fragments(self, text: bytes) -> list[bytes]:
        """The pieces between certain cuts."""
        return self._cut(text)[0]

    def _cut(self, text: bytes) -> tuple[list[bytes], list[int]]:
        """The pieces, and the numbers of those that may end in a blank."""
        if len(text) < 2:
            return ([text] if text else []), []
        b = np.frombuffer(text, np.uint8)
        pairs = b[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= b[1:]
        cut = np.flatnonzero(self.forced[pairs]) + 1
        last = b[cut - 1]
        blank = self.blank_end[last] & ((last < 0x80) | self.blank_mid[b[cut - 2]])
        return np.insert(b, cut, _SEPARATOR).tobytes().split(b"\xff"), np.flatnonzero(blank).tolist()

    def _numbers(self, text: bytes) -> list[int]:
        pieces, blank = self._cut(text)
        # A fragment that ends in a blank is read in the light of what follows.
        for i in blank:
            after = pieces[i + 1]
            if after != b"\xfe" and pieces[i].decode()[-1] in BLANK and after.decode()[0] not in BLANK:
                pieces[i] += b"\xff"
        get = self.seen.get
        out = list(map(get, pieces))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    p = pieces[i]
                    n = get(p)
                    out[i] = self._number(p) if n is None else n
        return out

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if self.held > self.most:
            self.forget()
        whole = b"\xfe".join(texts)
        if self.splitter is not None and any(s in whole for s in self.special):
            return self._with_specials(texts)
        n = np.asarray(self._numbers(whole), np.int64)
        ids, ends = self._spread(n)
        at = np.concatenate([np.flatnonzero(n == 0), [len(n)]]) if texts else np.empty(0, np.int64)
        return ids, np.diff(ends[at], prepend=0)

    def _spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments by their numbers, and where each fragment's ids begin (one more: the end)."""
        if not len(numbers):
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        starts, lengths, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.lengths, np.int64), np.frombuffer(self.flat, np.int32) if self.flat else np.empty(0, np.int32)
        size = lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(starts[numbers] - ends[:-1], size) + np.arange(ends[-1])], ends

    def _with_specials(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that spell special tokens: what stands between those is encoded for itself."""
        out, counts = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            for piece in self.splitter.split(text):
                if piece:
                    ids = np.array([self.special[piece]], np.int32) if piece in self.special else self._spread(np.asarray(self._numbers(piece), np.int64))[0]
                    out.append(ids)
                    counts[k] += len(ids)
        return (np.concatenate(out) if out else np.empty(0, np.int32)), counts

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text.encode()])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return self.tokens.decode(ids)


@lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


@lru_cache(2)
def coder(path: str) -> ForcedBoundaryBPE:
    """One coder per worker process and vocabulary."""
    return ForcedBoundaryBPE(path)


def slices(batch: pa.RecordBatch, columns: Sequence[str] = ("text",), most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in some columns each (one row alone where it has more), so that what Python holds does not follow the batch."""
    if not batch.num_rows:
        return
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        room = most + (int(ends[start - 1]) if start else 0)
        end = max(start + 1, int(np.searchsorted(ends, room, side="right")))
        yield batch.slice(start, end - start)
        start = end


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null becomes empty."""
    return pc.fill_null(column, "").cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()


def _coded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    wanted = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    fields = [T.StructField("doc_id", wanted.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, T.StructField("decoded", T.StringType())] if decoded else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ids, counts = c.encode_batch(as_bytes(part.column("text")))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
                if decoded:
                    every, at = ids.tolist(), offsets.tolist()
                    columns.append(pa.array([c.decode(every[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return wanted.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, ids as the library gives them without adding special tokens.

    Null and empty texts have no ids; repeated rows are encoded alike; an
    empty table gives an empty result.
    """
    return _coded(docs, vocabulary, id_col, text_col, False)


def code_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ``encode_documents`` and the text that each row's ids stand for, in one pass over the rows."""
    return _coded(docs, vocabulary, id_col, text_col, True)


def decode_documents(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t.decode(ids or ()) for ids in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
