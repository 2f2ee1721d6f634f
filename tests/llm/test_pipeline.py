"""The whole pipeline against a row-by-row version."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
from tokenizers import Tokenizer

from shelfwise.llm import decision_list, queries, semicrf_pii, setsketch, source_mix

from .fixtures import CLASHING, SCHEMA, frame, hard_rows, prose
from .test_operators import WORD, brute_components, brute_statistics, brute_targets, copies_of


def corpus():
    r, rows, at = random.Random(8), [], 100
    for k, (_, text, *rest) in enumerate(prose(70, seed=12)):
        words = text.split()
        words.insert(5, r.choice(["ann@site.org", "10.0.0.7", "+1 (234) 555-1234", "4111 1111 1111 1111", "and"]))
        text = " ".join(w + "###" for w in words) if k % 5 == 0 else " ".join(words)
        for c in copies_of(text, 4 if k % 9 == 1 else 1, k, 2):
            rows.append((at, c, rest[0], f"s{at % 4}" if at % 6 else None, len(c)))
            at += 1
    labels = [(r_[0], 0 if "###" in r_[1] else 1, 0) for r_ in rows if r_[0] % 2]
    return [x for x in hard_rows() if x[0] is not None] + rows, labels


def brute(rows, rules, field):
    def features(t):
        n, chars, symbols, dups, repeats = brute_statistics(t)
        return n, repeats, 1000 * symbols // max(n, 1)

    kept = []
    for row in rows:
        n, repeats, _ = features(row[1])
        bad = n < 50 or 100 * repeats > 50 * n
        if not bad and row[0] not in rules:
            kept.append(row)
    root = brute_components(kept, 5)
    seen, one = set(), []
    for row in kept:
        if root[row[0]][1] == row[0] and row[0] not in seen:
            seen.add(row[0])
            one.append(row)
    clean = [(i, semicrf_pii.redacted(t, semicrf_pii.all_spans(t, field)[1]), s) for i, t, _, s, _ in one]
    sizes, keyed = Counter(), defaultdict(list)
    for i, t, s in clean:
        n = len(WORD.findall(t))
        sizes[s] += n
        keyed[s].append((hashlib.md5(f"7:{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), n, i, t))
    library, out = Tokenizer.from_file(corpus_pipeline.VOCABULARY), []
    for s, target in brute_targets(sizes).items():
        epochs = int(target // sizes[s])
        room, before = target - epochs * sizes[s], 0
        for _, n, i, t in sorted(keyed[s]):
            ids = library.encode(t, add_special_tokens=False).ids
            for _ in range(epochs + (2 * (room - before) >= n)):
                out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
            before += n
    return sorted(out)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = corpus()
    folder = str(tmp_path)
    frame(spark, rows, extra=False).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rules = decision_list.learn(*decision_list.labelled_cells(docs, lab))
    assert rules
    rejected = {r["doc_id"] for r in decision_list.judge_quality(docs, rules).where("rule > 0").collect()}
    assert {r[0] for r in rows if r[1] and "###" in r[1]} <= rejected
    second = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality_rules(spark, docs, folder), folder)
    assert second.schema == docs.schema
    field = semicrf_pii.train(semicrf_pii.training_windows(second))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == brute(rows, rejected, field)


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    rows, labels = corpus()
    folder = str(tmp_path)
    plain = [*rows[:60], (None, rows[20][1], "en", "s1", 5)]
    frame(spark, plain).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {tuple(r) for r in out.select(*CLASHING).distinct().collect()} <= {("clash",) * len(CLASHING)}
        docs = out
    assert docs.count() and corpus_pipeline.run(spark, folder).count() == corpus_pipeline.bpe_encoding(spark, docs, folder).count()


def test_rows_of_one_id_leave_the_same_one(spark):
    rows = [(1, " ".join(f"{x}{k}" for k in range(60)), "en", "s", 0) for x in "abcdef"] + [(2, "", "en", "s", 0), (2, None, "de", "s", 0), (None, None, None, None, None)]
    found = [sorted(map(tuple, corpus_pipeline.near_duplicates(spark, frame(spark, r, extra=False).repartition(n), "").collect()), key=str) for r, n in ((rows, 1), (rows[::-1], 4))]
    assert found[0] == found[1] and [r[0] for r in found[0]].count(1) == 1 and len(found[0]) == 3


def test_stages_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and setsketch and source_mix
