"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a document's bytes, blanks included, in both directions and
gives every position a distribution over languages; a document's distribution
is the mean over all its positions.  So that a task reads thousands of
documents in step and a long one is no long chain, documents are read in
windows of ``WINDOW`` bytes; the state enters a window after reading the
``CONTEXT`` bytes before it (from behind: after it), or all there are.  A text
of one window is read in one piece.  Training is backpropagation through time in numpy on the driver, on a
bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import crc_class

WINDOW, CONTEXT = 256, 48
_LETTER = regex.compile(r"\p{L}")
#: The symbol that stands where a text has no byte; it leaves the state as it is.
_NOTHING = 256
_LANES = 1024


def _bent(x):
    """The network's bounded function, between -1 and 1; its slope is (1 - |y|) ** 2."""
    return x / (1 + np.abs(x))


def _gate(x):
    return 0.5 + 0.5 * _bent(x)


def _softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class BiGRU:
    """Weights by name, and the languages in order."""

    w: dict[str, np.ndarray]
    languages: list[str]

    @classmethod
    def new(cls, languages: list[str], embed: int = 8, hidden: int = 12, seed: int = 5) -> BiGRU:
        r = np.random.default_rng(seed)
        w = {"E": r.normal(0, 0.5, (256, embed)), "Wo": r.normal(0, 0.2, (2 * hidden, len(languages))), "bo": np.zeros(len(languages))}
        for d in "fb":
            w |= {f"Wx{d}": r.normal(0, embed**-0.5, (embed, 3 * hidden)), f"Wh{d}": r.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"bx{d}": np.zeros(3 * hidden)}
        return cls({k: v.astype(np.float32) for k, v in w.items()}, languages)

    def _scan(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction, (T, B, H); with ``keep`` also what the way back needs."""
        w, H = self.w, self.w[f"Wh{d}"].shape[0]
        T_, B = mask.shape
        wx = self.w["E"] @ w[f"Wx{d}"] + w[f"bx{d}"]  # input part of every byte
        h, out, kept = np.zeros((B, H), np.float32), np.zeros((T_, B, H), np.float32), {}
        for t in range(T_) if d == "f" else range(T_ - 1, -1, -1):
            a = wx[x[t]]
            g = h @ w[f"Wh{d}"]
            zr = _gate(a[:, : 2 * H] + g[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = _bent(a[:, 2 * H :] + r * g[:, 2 * H :])
            m = mask[t][:, None]
            new = h + m * (1 - z) * (c - h)
            if keep:
                kept[t] = (h, z, r, c, g[:, 2 * H :])
            h = new
            out[t] = h
        return out, kept

    def positions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Distribution over languages at every position, (T, B, L)."""
        f, _ = self._scan(x, mask, "f", False)
        b, _ = self._scan(x, mask, "b", False)
        return _softmax(np.concatenate([f, b], -1) @ self.w["Wo"] + self.w["bo"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        w, g = self.w, {k: np.zeros_like(v) for k, v in self.w.items()}
        f, kept_f = self._scan(x, mask, "f", True)
        b, kept_b = self._scan(x, mask, "b", True)
        both = np.concatenate([f, b], -1)
        p = _softmax(both @ w["Wo"] + w["bo"])
        n = max(1.0, float(mask.sum()))
        loss = float(-(np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*mask.shape, 1)), -1)[..., 0] + 1e-9) * mask).sum() / n)
        dy = p.copy()
        np.put_along_axis(dy, np.broadcast_to(y[None, :, None], (*mask.shape, 1)), np.take_along_axis(dy, np.broadcast_to(y[None, :, None], (*mask.shape, 1)), -1) - 1, -1)
        dy *= (mask / n)[..., None]
        g["Wo"] = np.einsum("tbh,tbl->hl", both, dy)
        g["bo"] = dy.sum((0, 1))
        back = dy @ w["Wo"].T
        H = f.shape[-1]
        for d, kept, dh_out in (("f", kept_f, back[..., :H]), ("b", kept_b, back[..., H:])):
            dh = np.zeros_like(f[0])
            for t in reversed(list(kept)):
                h, z, r, c, gc = kept[t]
                m = mask[t][:, None]
                dh = dh + dh_out[t]
                d_new = dh * m
                dc = d_new * (1 - z) * (1 - np.abs(c)) ** 2
                dz = d_new * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dc * gc * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                da = np.concatenate([dz, dr, dc], 1)
                dg = np.concatenate([dz, dr, dc * r], 1)
                e = w["E"][x[t]]
                g[f"Wx{d}"] += e.T @ da
                g[f"bx{d}"] += da.sum(0)
                g[f"Wh{d}"] += h.T @ dg
                np.add.at(g["E"], x[t], da @ w[f"Wx{d}"].T)
                dh = dh * (1 - m) + d_new * z + dg @ w[f"Wh{d}"].T
        return loss, g


def packed(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, mask), each (T, B)."""
    T_ = max(map(len, segments))
    x, m = np.zeros((T_, len(segments)), np.uint8), np.zeros((T_, len(segments)), np.float32)
    for i, s in enumerate(segments):
        x[: len(s), i] = np.frombuffer(s, np.uint8)
        m[: len(s), i] = 1
    return x, m


def train(pairs: list[tuple[str, str]], epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 5, hidden: int = 12) -> BiGRU | None:
    """Network from (language, stretch of text) pairs; None without any."""
    languages = sorted({p[0] for p in pairs})
    data = [(s, languages.index(lang)) for lang, w in sorted(pairs) if (s := w.lower().encode())]
    if not data:
        return None
    net, r = BiGRU.new(languages, hidden=hidden, seed=seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in net.w.items()}, {k: np.zeros_like(a) for k, a in net.w.items()}, 0
    lengths = np.array([len(s) for s, _ in data])
    for epoch in range(epochs):
        order = r.permutation(len(data))
        order = order[np.argsort(lengths[order] // 8, kind="stable")]  # like lengths together
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for k in r.permutation(len(groups)):
            chosen = [data[i] for i in groups[k]]
            x, mask = packed([s for s, _ in chosen])
            _, g = net.gradients(x, mask, np.array([y for _, y in chosen]))
            step += 1
            lr = rate * (1 - epoch / epochs)
            for name, a in net.w.items():
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                a -= (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def training_stretches(docs: DataFrame, docs_per_language: int = 400, per_language: int = 800, characters: int = 80, most: int = 200_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """A bounded sample of (language, stretch of text) from every language.

    Of each language about ``docs_per_language`` documents by hash (all of a
    rarer one) and at most ``per_language`` different stretches of so many
    characters at places by hash, those with the lowest hashes; fewer of each
    where all together would be more than ``most``, one at least.  Shares, not
    ranks, choose the documents, so a language that most documents are in is no
    task of its own.
    """
    known = docs.where((crc_class(F.col(id_col)) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    if not counts:
        return []
    per_language = max(1, min(per_language, most // len(counts)))
    least = 1 << 20
    shares = [(r["lang"], min(least, -(-docs_per_language * least // r["n"])), -(-per_language // min(r["n"], docs_per_language))) for r in counts]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(shares, T.StructType([T.StructField("lang", docs.schema[lang_col].dataType), T.StructField("share", T.LongType()), T.StructField("k", T.LongType())])))
    chosen = known.join(wanted, "lang").where(F.pmod(F.xxhash64("id", "lang"), F.lit(least)) < F.col("share"))
    room = F.greatest(F.length("body") - characters, F.lit(0)) + 1
    at = lambda i: F.pmod(F.xxhash64("id", "lang", i), room).cast("int") + 1
    cut = chosen.select("lang", "id", F.explode(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.struct(F.xxhash64("id", i, "body").alias("h"), F.substring("body", at(i), F.lit(characters)).alias("text")))).alias("s"))
    rows = cut.select("lang", "s.h", "s.text").where("text <> ''").distinct()
    lowest = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("nth") <= per_language)
    return [(r["lang"], r["text"]) for r in sorted(lowest.collect(), key=lambda r: (r["lang"], r["nth"]))]


class Reader:
    """Pooled distributions of texts."""

    def __init__(self, net: BiGRU, window: int = WINDOW, context: int = CONTEXT):
        self.window, self.context, self.languages = window, context, len(net.languages)
        w, self.gates = net.w, {}
        H = self.H = w["Whf"].shape[0]
        for k, d in enumerate("fb"):
            x = np.concatenate([w["E"] @ w[f"Wx{d}"] + w[f"bx{d}"], np.zeros((1, 3 * H), np.float32)])
            x[_NOTHING, :H] = 1e30  # the gate that keeps the state is open
            wh = w[f"Wh{d}"]
            self.gates[d] = [np.ascontiguousarray(m, np.float32) for m in (x[:, :H], x[:, H : 2 * H], x[:, 2 * H :], wh[:, :H], wh[:, H : 2 * H], 0.5 * wh[:, 2 * H :], w["Wo"][k * H : (k + 1) * H])]
        self.bias = w["bo"].astype(np.float32)

    def _scan(self, x: np.ndarray, d: str, logits: np.ndarray) -> None:
        """Read the rows of x (steps, lanes) one after another; what the last len(logits) states say is added to logits."""
        of_z, of_r, of_c, z_by, r_by, c_by, out_by = self.gates[d]
        (steps, lanes), H = x.shape, self.H
        silent, part = steps - len(logits), np.empty((lanes, self.languages), np.float32)
        h = np.zeros((lanes, H), np.float32)
        z, r, c, g, size = (np.empty((lanes, H), np.float32) for _ in range(5))

        def bent(a: np.ndarray) -> None:
            np.abs(a, out=size)
            np.add(size, 1, out=size)
            np.divide(a, size, out=a)

        def reach(a: np.ndarray, by: np.ndarray, of: np.ndarray) -> None:
            np.matmul(h, by, out=a)
            np.take(of, x[t], axis=0, out=size, mode="clip")
            np.add(a, size, out=a)

        for t in range(steps):
            reach(z, z_by, of_z)
            bent(z)
            reach(r, r_by, of_r)
            bent(r)
            np.matmul(h, c_by, out=g)  # half of it: gates are half of 1 + r, of 1 - z
            np.multiply(r, g, out=c)
            np.add(c, g, out=c)
            np.take(of_c, x[t], axis=0, out=size, mode="clip")
            np.add(c, size, out=c)
            bent(c)
            np.subtract(c, h, out=c)
            np.subtract(1, z, out=z)
            np.multiply(c, z, out=c)
            np.multiply(c, 0.5, out=c)
            np.add(h, c, out=h)
            if t >= silent:
                np.matmul(h, out_by, out=part)
                logits[t - silent] += part

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean distribution, positions by label, positions) of each text."""
        L, W, C = self.languages, self.window, self.context
        raw = [t.lower().encode() for t in texts]
        size = np.array([len(b) for b in raw], np.int64)
        text = np.concatenate([np.frombuffer(b"".join(raw), np.uint8).astype(np.int16), np.array([_NOTHING], np.int16)])
        begin = np.cumsum(size) - size
        n_windows = -(-size // W)
        doc = np.repeat(np.arange(len(raw)), n_windows)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * W
        length = np.minimum(size[doc] - start, W)
        order = np.argsort(length, kind="stable")
        sums, labels = np.zeros((len(raw), L)), np.zeros((len(raw), L))
        lanes = max(16, min(_LANES, 4 * _LANES // L))
        for k in range(0, len(order), lanes):
            part = order[k : k + lanes]
            d, s, n = doc[part], start[part], length[part]
            steps = int(n.max())

            def bytes_at(offsets: np.ndarray, d=d, s=s) -> np.ndarray:
                """Symbols at the offsets from each lane's window start, (offsets, lanes)."""
                at = s[None, :] + offsets[:, None]
                inside = (at >= 0) & (at < size[d])
                return text[np.where(inside, begin[d] + at, len(text) - 1)].astype(np.intp)

            logits = np.tile(self.bias, (steps, len(part), 1))
            before, after = min(C, int(s.max())), min(C, int((size[d] - s - n).max()))
            self._scan(bytes_at(np.arange(-before, steps)), "f", logits)
            self._scan(bytes_at(np.arange(steps + after - 1, -1, -1)), "b", logits[::-1])
            np.exp(np.clip(logits, -80, 80, out=logits), out=logits)
            inside = np.arange(steps)[:, None] < n[None, :]
            share = inside / (logits @ np.ones(L, np.float32))
            np.add.at(sums, d, np.einsum("tbl,tb->bl", logits, share.astype(np.float32)))
            most, best = logits[..., 0].copy(), np.where(inside, 0, -1)
            for y in range(1, L):
                higher = inside & (logits[..., y] > most)
                best[higher] = y
                np.maximum(most, logits[..., y], out=most)
            for y in range(L):
                np.add.at(labels[:, y], d, (best == y).sum(0))
        return sums / np.maximum(size, 1)[:, None], labels, size


_readers: dict[bytes, Reader] = {}


def reader(net: BiGRU) -> Reader:
    """One reader per worker process and network."""
    key = net.w["Wo"].tobytes() + net.w["E"].tobytes()
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(net)
    return _readers[key]


def predict(docs: DataFrame, net: BiGRU | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_positions, n_agreeing) of every row.

    n_positions: bytes read; n_agreeing: those whose own label is the document's.  Null, empty and
    letterless texts are ``und`` with score 0, as all are without a network;
    equal texts get equal predictions, ties go to the language first in order.
    """
    wanted = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType(
        [T.StructField("doc_id", wanted.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_positions", T.LongType()), T.StructField("n_agreeing", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                lettered = np.array([bool(_LETTER.search(t)) for t in texts], bool)
                lang, score, n, agree = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
                if net is not None:
                    p, labels, n = reader(net).read([t if ok else "" for t, ok in zip(texts, lettered, strict=True)])
                    best = p.argmax(1)
                    lang = [net.languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                    score = np.clip(np.where(lettered, p.max(1), 0.0), 0, 1)
                    agree = np.where(lettered, np.take_along_axis(labels, best[:, None], 1)[:, 0], 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n.astype(np.int64)), pa.array(agree.astype(np.int64))], schema.names)

    return wanted.mapInArrow(run, schema)
