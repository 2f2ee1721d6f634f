import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from shelfwise.llm import bpe, token_alignment
from shelfwise.llm.queries import op11_spill_counted_alignment

from .fixtures import empty, frame, hard_rows, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute_force(texts):
    """Rows of COLUMNS for a list of texts, by the libraries and all pairs of ranges."""
    a_side, b_side = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    back = {c: b for b, c in bpe.byte_alphabet().items()}
    out, linked, count = [], [], Counter()
    for text in texts:
        rows = []
        if text:
            a_ids, b_ids = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            a = [bytes(back[c] for c in a_side.id_to_token(i)) for i in a_ids]
            b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b_side.id_to_piece(i)]]
            if b"".join(a) == b"".join(b) == (" " + text).encode():
                rows = [(a_ids, a), (b_ids, b)]
        if not rows:
            out.append([0, 0, 0, 0, 0, 0, ""])
            linked.append([])
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for _, side in rows]
        spans = [list(zip([0, *e], e, ids, strict=False)) for e, (ids, _) in zip(ends, rows, strict=True)]
        links = [(j, i) for x, y, i in spans[0] for u, v, j in spans[1] if max(x, u) < min(y, v)]
        groups, before = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for _, y, i in side if before < y <= end) for side in spans))
            before = end
        count.update(links)
        linked.append(links)
        out.append([len(rows[0][0]), len(rows[1][0]), len(groups), len(links), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest()])
    most = {}
    for (j, _), n in count.items():
        most[j] = max(most.get(j, 0), n)
    for row, links in zip(out, linked, strict=True):
        row[4] = sum(count[x] == most[x[0]] for x in links)
        row[5] = sum(count[x] for x in links)
    return [tuple(r) for r in out]


def short_rows():
    rows = [r for r in hard_rows() if r[0] not in (4, 7)] + [(r[0] + 100, *r[1:]) for r in prose(60, length=(1, 60))]
    return rows + [(300, "a▁b is not a blank", "en", "a", 0), (301, "▁", "en", "a", 0), (302, "x" * 700 + " naïve  ①😀\r\n\t<s> <|endoftext|>", "en", "a", 0)]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_all_pairs_of_ranges(spark, monkeypatch, small):
    if small:  # many runs, frames and parts
        for name, value in (("RUN_BYTES", 600), ("RUN_DOCS", 8), ("RUNS_A_TASK", 3), ("FRAME", 7)):
            monkeypatch.setattr(token_alignment, name, value)
    rows = short_rows()
    got = token_alignment.align_tokens(frame(spark, rows), A, B).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute_force([r[1] for r in rows]), strict=True)]
    assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got), key=repr) == sorted(want, key=repr)


def test_long_texts_groups_and_query(spark, tmp_path):
    rows = hard_rows()
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_spill_counted_alignment(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    groups = {(r["doc_id"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in token_alignment.token_groups(docs, A, B).collect()}
    assert {(r["doc_id"], r["groups_sha256"]) for r in got} == groups
    assert sum(r["n_links"] > 0 for r in got) == sum(bool(r[1]) for r in rows)


def test_empty_table(spark):
    assert token_alignment.align_tokens(empty(spark), A, B).count() == 0


def test_string_ids(spark):
    docs = frame(spark, prose(5)).withColumn("name", F.concat(F.lit("d"), "doc_id"))
    assert sorted(r["doc_id"] for r in token_alignment.align_tokens(docs, A, B, id_col="name").collect()) == [f"d{i}" for i in range(5)]


def test_merging_runs():
    r = np.random.default_rng(3)
    runs = [np.unique(r.integers(0, 500, n)) for n in (1, 0, 40, 300, 300)]
    frames = [[(k[at : at + 5], np.arange(len(k))[at : at + 5]) for at in range(0, len(k), 5)] for k in runs]
    merged = list(token_alignment.merged_runs(frames))
    keys, sums = (np.concatenate(c) for c in zip(*merged, strict=True))
    want = Counter()
    for k in runs:
        want.update({int(x): i for i, x in enumerate(k)})
    assert keys.tolist() == sorted({int(x) for k in runs for x in k})
    assert {int(k): int(n) for k, n in zip(keys, sums, strict=True)} == {k: want[k] for k in keys.tolist()}
