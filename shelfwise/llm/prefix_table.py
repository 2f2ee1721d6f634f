"""SentencePiece encoding and decoding by a merge-type prefix table.

Merging cannot see across the end of a token, so what stands before the last
token of an encoding is the encoding of what is left of the text, and a row of
tokens is an encoding exactly if each two neighbours are one.  Every prefix of
a text therefore has one last token: among the vocabulary's tokens that end
there (an automaton finds all of them in one pass) the one that is compatible
with the last token of the prefix before it.  The table of last tokens is
filled from left to right, the ids are read from it backwards, and time grows
with the length of the text, however long a stretch without blanks is.

Texts are cut at byte pairs that no token holds before their tables are filled
(``bpe`` says why that is exact), since most fragments recur and a worker
remembers what it has met.  Blanks stand for themselves here, not for U+2581.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _SEPARATOR, _TEXT_END, MOST_BYTES, ForcedBoundaryBPE, as_bytes, slices

#: What stands for a blank in pieces (fixed value).
BLANK_SIGN = "▁"
_UNKNOWN, _START = -1, -2
#: Verdicts on pairs of tokens that a worker remembers.
MOST_PAIRS = 300_000


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("shelfwise-one-byte", _one_byte)


class Pieces:
    """The pieces of a model file with byte fallback: their texts, scores and bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize("  ﬁ  x") != "▁▁▁ﬁ▁▁x":
            raise ValueError(f"{path}: only models that put one blank before a text and change nothing else are supported")
        self.bytes: list[bytes] = []
        self.raw_byte = [0] * 256
        self.text: dict[str, int] = {}
        self.score: list[float] = []
        #: Ids of control pieces, and of pieces that begin with a blank.
        self.silent, self.led = set(), set()
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            self.score.append(model.get_score(i))
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.raw_byte[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i):
                self.silent.add(i)
                self.bytes.append(b"")
            elif model.is_unknown(i):
                self.bytes.append(" ⁇ ".encode())
            else:
                own = piece.replace(BLANK_SIGN, " ")
                self.text[own] = i
                self.bytes.append(own.encode())
                if own[0] == " ":
                    self.led.add(i)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of some ids without the blank that stands before every text; each byte that is no UTF-8 becomes U+FFFD."""
        out, led = [], None
        for silent, run in groupby(ids, self.silent.__contains__):
            if not silent:
                run = list(run)
                led = run[0] in self.led if led is None else led
                out.append(b"".join(map(self.bytes.__getitem__, run)).decode("utf-8", "shelfwise-one-byte"))
        return "".join(out)[bool(led) :]


class PrefixTable(ForcedBoundaryBPE):
    """Encoder of one model file of the sentencepiece library; fragments are kept as its base class keeps them."""

    def __init__(self, path: str, most_bytes: int = MOST_BYTES):
        self.pieces = pieces(path)
        self.most, self.splitter = most_bytes, None
        text = self.pieces.text
        # Merging prefers the higher score, then what stands further left.
        self.rank = {t: -self.pieces.score[i] for t, i in text.items()}
        # Characters that only longer pieces hold are tokens while merging goes on; on the way out they are bytes.
        self.letters = sorted({c for t in text for c in t}.difference(text))
        self.tokens_of = {**text, **{c: len(self.pieces.bytes) + k for k, c in enumerate(self.letters)}}
        self.spelling = {i: t for t, i in self.tokens_of.items()}
        self.matches = ahocorasick.Automaton()
        for t, i in self.tokens_of.items():
            self.matches.add_word(t, (i, len(t)))
        self.matches.make_automaton()
        self.size = {i: len(t) for i, t in self.spelling.items()}
        joined = np.zeros(65536, bool)
        for raw in map(str.encode, text):
            for a, b in zip(raw, raw[1:], strict=False):
                joined[a << 8 | b] = True
        left, right = np.arange(65536) >> 8, np.arange(65536) & 255
        self.forced = (~joined & ((right & 0xC0) != 0x80)) | (left == _TEXT_END) | (right == _TEXT_END)
        self.verdicts: dict[int, bool] = {}
        self.edges: dict[int, tuple | None] = {}
        self.forget()

    def _cut(self, text: bytes) -> tuple[list[bytes], list[int]]:
        if len(text) < 2:
            return ([text] if text else []), []
        b = np.frombuffer(text, np.uint8)
        pairs = b[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= b[1:]
        return np.insert(b, np.flatnonzero(self.forced[pairs]) + 1, _SEPARATOR).tobytes().split(b"\xff"), []

    def _edges(self, token: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """How the first and the last part of a token grow while its characters are merged: (what rank the merges up to this one have at most, part); None if merging ends elsewhere."""
        parts, rank = list(token), self.rank
        first, last = [(-np.inf, parts[0])], [(-np.inf, parts[-1])]
        since_first = since_last = -np.inf
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return None
            since_first, since_last = max(since_first, best), max(since_last, best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                first.append((since_first, parts[0]))
                since_first = -np.inf
            if at == len(parts) - 1:
                last.append((since_last, parts[-1]))
                since_last = -np.inf
        return first, last

    def _known_edges(self, t: int) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        if t not in self.edges:
            self.edges[t] = self._edges(self.spelling[t])
        return self.edges[t]

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge joins two tokens while both come about.

        The parts on both sides of their border grow in turns, the one whose
        merges have the lower rank first, the left one of equals; their own
        merge would come in between where its rank is lower still.
        """
        own, other = self._known_edges(right), None
        if own is None or left < 0:
            return own is not None
        other = self._known_edges(left)
        a, b, i, j, rank = other[1], own[0], 1, 1, self.rank
        while True:
            joined = rank.get(a[i - 1][1] + b[j - 1][1])
            next_a = a[i][0] if i < len(a) else np.inf
            next_b = b[j][0] if j < len(b) else np.inf
            if joined is not None and joined < next_a and joined <= next_b:
                return False
            if next_a == next_b == np.inf:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` in an encoding; after the start or a character of no piece: whether it is an encoding itself."""
        pair = left << 32 | right
        known = self.verdicts.get(pair)
        if known is None:
            if len(self.verdicts) > MOST_PAIRS:
                self.verdicts.clear()
            known = self.verdicts[pair] = self._stays_apart(left, right)
        return known

    def last_tokens(self, text: str) -> list[int]:
        """The last token of every prefix of a text; the empty prefix has none."""
        last = [_UNKNOWN] * (len(text) + 1)
        last[0] = _START
        get, compatible = self.verdicts.get, self.compatible
        for end, (t, size) in self.matches.iter(text):
            end += 1
            if last[end] == _UNKNOWN:
                before = last[end - size]
                known = get(before << 32 | t)
                if known or (known is None and compatible(before, t)):
                    last[end] = t
        return last

    def _encode_fragment(self, fragment: bytes) -> list[int]:
        text = fragment.decode()
        whole = self.pieces.text.get(text)
        if whole is not None and self.compatible(_START, whole):
            return [whole]
        last, ids, at, model = self.last_tokens(text), [], len(text), len(self.pieces.bytes)
        while at:
            t = last[at]
            if t == _UNKNOWN or t >= model:
                ids += [self.pieces.raw_byte[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                ids.append(t)
                at -= self.size[t]
        return ids[::-1]

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        sign = BLANK_SIGN.encode()
        return super().encode_batch([b" " + t.replace(sign, b" ") if t else t for t in texts])

    def decode(self, ids: Iterable[int]) -> str:
        return self.pieces.decode(ids)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(2)
def coder(path: str) -> PrefixTable:
    """One coder per worker process and model."""
    return PrefixTable(path)


def code_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as the library gives them without begin and end, and the text they stand for, in one pass.

    Null and empty texts have no ids; repeated rows are encoded alike; an
    empty table gives an empty result.  Characters that no piece holds become
    the ids of their bytes; control pieces spelt out in a text are text.
    """
    wanted = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("doc_id", wanted.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            for part in slices(batch):
                ids, counts = c.encode_batch(as_bytes(part.column("text")))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                every, at = ids.tolist(), offsets.tolist()
                decoded = pa.array([c.decode(every[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), decoded], schema.names)

    return wanted.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [p.decode(ids or ()) for ids in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
