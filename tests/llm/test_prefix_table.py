import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from shelfwise.llm import prefix_table
from shelfwise.llm.queries import op13_prefix_table_pieces

from .fixtures import empty, frame, hard_rows, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return prefix_table.PrefixTable(MODEL)


def encoded(coder, texts):
    ids, n = coder.encode_batch([t.encode() for t in texts])
    ends = np.concatenate([[0], np.cumsum(n)])
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_ids_and_texts_are_the_library_s(library, coder):
    r = random.Random(5)
    pieces = [library.id_to_piece(i) for i in range(3, 32000)]
    odd = [" ", "  ", "\t", "\n", "a", "th", "ing", "é", "中", "😀", "①", "<s>", "<0x41>", "▁", "\x00", "　", "́", "​", "1", "'", "====", "x" * 7]
    texts = ["", " ", "a", *("".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(1500))]
    texts += ["".join(r.choice(odd) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randint(0, 0x7F), r.randint(0x80, 0x3000), r.randint(0x4E00, 0x9FFF)])) for _ in range(20)) for _ in range(500)]
    texts += [" " * 5000, "x" * 5000, "=-" * 2000, "中文" * 1000, "the" * 2000]
    got = encoded(coder, texts)
    assert got == library.encode(texts)
    assert [coder.decode(ids) for ids in got] == [library.decode(ids) for ids in got]


def test_decoding_any_ids(library, coder):
    r = random.Random(6)
    rows = [[r.randint(0, 300) if r.random() < 0.7 else r.randint(0, 31999) for _ in range(r.randint(0, 12))] for _ in range(3000)]
    assert [coder.decode(ids) for ids in rows] == [library.decode(ids) for ids in rows]


def test_each_prefix_has_the_last_token_of_its_own_encoding(library, coder):
    text = " thereupon unbelievably 12 == naïve"
    last = coder.last_tokens(text)
    for n in range(1, len(text) + 1):
        # the library puts the first blank itself
        assert last[n] == (library.encode(text[1:n])[-1] if n > 1 else coder.pieces.text[" "])
    # and no other token that ends there could stand in its place
    for n in range(1, len(text) + 1):
        fits = {t for at in range(n) for t in [coder.pieces.text.get(text[at:n])] if t is not None and coder.compatible(last[at], t)}
        assert fits == {last[n]}


def test_tables_are_forgotten_without_harm(library):
    small = prefix_table.PrefixTable(MODEL, most_bytes=2_000)
    for _, text, *_ in prose(40):
        assert encoded(small, [text]) == [library.encode(text)]


def test_documents(spark, library, tmp_path):
    docs = frame(spark, hard_rows())
    rows = prefix_table.code_documents(docs, MODEL).collect()
    assert len(rows) == len(hard_rows())
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, *_ in hard_rows()), key=repr)
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in rows), key=repr) == want
    back = prefix_table.decode_documents(prefix_table.code_documents(docs, MODEL).drop("decoded").withColumn("n", F.lit(1)), MODEL)
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in back.collect()), key=repr) == want
    frame(spark, hard_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op13_prefix_table_pieces(spark, str(tmp_path)).where("doc_id = 8").collect():
        ids = library.encode(hard_rows()[-2][1])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert prefix_table.code_documents(empty(spark), MODEL).count() == 0
