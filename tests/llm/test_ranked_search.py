import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import ranked_search
from shelfwise.llm.queries import op12_hybrid_ranked_search

from .fixtures import empty, frame, hard_rows, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(rows, items, k):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    n, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in docs:
            m = 50 + 50 * c.total() * n // total if total else 50
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out)


def found(spark, rows, items, k):
    got = ranked_search.search(frame(spark, rows), spark.createDataFrame(items, ITEMS), k)
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect())


ASKED = [(1, "the CAT sat; übermut"), (2, None), (3, ""), (4, "!!! ..."), (5, "word1 word2 and and here"), (6, "nothing of this: zzzz"), (7, "中文 😀 123")]


def test_search_equals_scoring_all_documents(spark, tmp_path):
    rows = hard_rows()
    assert found(spark, rows, ASKED, 3) == brute_force(rows, ASKED, 3)
    # through the query, and by its SQL
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ASKED, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, op12_hybrid_ranked_search(spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == brute_force(rows, ASKED, 50)
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert sorted(db.sql(ranked_search.ORACLE).fetchall()) == got


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_skipping_loses_nothing(spark, monkeypatch, k):
    for name, value in (("SEGMENT_BYTES", 9_000), ("RANGE", 7), ("BLOCK_BYTES", 500), ("SHORT_SHARE", 0.2)):
        monkeypatch.setattr(ranked_search, name, value)
    r = random.Random(k)
    rows = prose(150, seed=k, vocabulary=60, length=(0, 60)) + [(1000 + i, "same words in all of these " * (i % 2 + 1), "en", "s", 0) for i in range(40)]
    vocabulary = sorted({t for x in rows for t in terms(x[1])})
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12)))) for i in range(30)] + [(40, "same words"), (40, "same words")]
    assert found(spark, rows, items, k) == sorted(brute_force(rows, items, k))


def test_segments_read_by_bounds():
    r = np.random.default_rng(2)
    for least, share in ((1, 0.0), (400, 0.3), (900, 1.0)):
        lists = []
        for size in (3, 10, 200, 900):
            docs = np.sort(r.choice(1000, size, replace=False))
            lists.append((docs, r.integers(1, 100_000 // size, size)))
        want = np.zeros(1000, np.int64)
        for docs, scores in lists:
            want[docs] += scores
        ranked_search.SHORT_SHARE, kept = share, ranked_search.SHORT_SHARE
        best = ranked_search.Best(10)
        ranked_search.read_segment([ranked_search.Postings(*p) for p in lists], 1000, np.arange(1000), best)
        ranked_search.SHORT_SHARE = kept
        order = np.lexsort((np.arange(1000), -want))[:10]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == want[order].tolist()


def test_empty_tables(spark):
    assert found(spark, [], ASKED, 3) == []
    assert ranked_search.search(empty(spark), spark.createDataFrame([], ITEMS)).count() == 0
    assert ranked_search.search(frame(spark, hard_rows()), spark.createDataFrame([], ITEMS)).count() == 0


def test_string_items_and_clashing_names(spark):
    items = spark.createDataFrame([("q", "the cat"), (None, "cat")], "item_id string, text string").withColumn("score", F.lit(1))
    assert ranked_search.search(frame(spark, hard_rows()), items, 2).count() == 4


def test_norms_beyond_64_bits():
    assert ranked_search.length_norms(np.array([2_000_000_000]), 10**11, 10**14).tolist() == [50 + 50 * 2_000_000_000 * 10**11 // 10**14]
