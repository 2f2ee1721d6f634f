import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import bigru_lang, bpe, decision_list, deleted_interpolation, license_scan, license_texts, media_chunks, semicrf_pii, setsketch, source_mix, token_cache

from shelfwise.llm.common import hot_keys, join_spread

from .fixtures import empty, frame, hard_rows, prose

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, hard_rows()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return empty(spark)


# 1 -------------------------------------------------------------------------------


def test_interpolation_equals_row_by_row_model(spark, monkeypatch):
    monkeypatch.setattr(deleted_interpolation, "CHUNK_BYTES", 9_000)
    learned = {}
    fit = deleted_interpolation.mixture_weights
    monkeypatch.setattr(deleted_interpolation, "mixture_weights", lambda e, v: learned.setdefault("w", fit(e, v)))
    rows = hard_rows()[:3] + hard_rows()[4:6] + prose(60) + [(100, None, None, None, None)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = {r["doc_id"]: r for r in deleted_interpolation.score_documents(frame(spark, rows)).collect()}
    texts = {i: WORD.findall(lowered(r[1])) + ["\n"] for i, r in enumerate(rows)}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    one = Counter(w for i in train for w in texts[i])
    n, v = sum(one.values()), len(one)
    two = Counter(p for i in train for p in zip(["<s>", *texts[i]], texts[i], strict=False))
    seen = {**one, "<s>": len(train)}
    w = learned["w"]
    assert np.allclose(w.sum(1), 1)
    for i, words in texts.items():
        base = sum(math.log10((one[t] + 0.5) / (n + 0.5 * (v + 1))) for t in words)
        own = 0.0
        for h, t in zip(["<s>", *words], words, strict=False):
            c = seen.get(h, 0)
            a = w[min(int(math.log2(c + 1)), deleted_interpolation.BUCKETS - 1)]
            own += math.log10(a[0] * two[h, t] / max(c, 1) + a[1] * one[t] / n + a[2] / (v + 1))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(one[t] > 0 for t in words), n)
        assert r["held_out"] == (i not in train)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(own)


def test_weights_equal_expectation_maximisation_event_by_event(spark, monkeypatch):
    learned = {}
    fit = deleted_interpolation.mixture_weights
    monkeypatch.setattr(deleted_interpolation, "mixture_weights", lambda e, v: learned.setdefault("w", fit(e, v)))
    rows = prose(150, seed=3, vocabulary=60)
    docs = frame(spark, rows)
    deleted_interpolation.score_documents(docs)
    left_out = {r[0] for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(deleted_interpolation.HELD_OUT_SHARE)) == 0).select("doc_id").collect()}
    texts = {r[0]: WORD.findall(lowered(r[1])) + ["\n"] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1}
    kept, held = [t for i, t in texts.items() if i not in left_out], [t for i, t in texts.items() if i in left_out]
    assert kept and held
    one, two = Counter(w for t in kept for w in t), Counter(p for t in kept for p in zip(["<s>", *t], t, strict=False))
    n, v, seen = sum(one.values()), len(one), {**one, "<s>": len(kept)}
    events = defaultdict(list)
    for t in held:
        for h, x in zip(["<s>", *t], t, strict=False):
            c = seen.get(h, 0)
            events[min(int(math.log2(c + 1)), deleted_interpolation.BUCKETS - 1)].append((two[h, x] / max(c, 1), one[x] / n, 1 / (v + 1)))

    def em(rows, w):
        for _ in range(60):
            total = np.full(3, 1e-3)
            for p in rows:
                share = np.array(p) * w
                total += share / share.sum()
            w = total / total.sum()
        return w

    pooled = em([p for b in sorted(events) for p in events[b]], np.array([0.3, 0.6, 0.1]))
    for b, found in events.items():
        want = em(found, pooled)
        if b:
            assert np.abs(learned["w"][b] - want).max() < 0.02, b


def test_interpolation_beats_the_base_on_unseen_documents(spark):
    r = random.Random(4)
    chain = {w: [r.choice("abcdefgh") * 3 for _ in range(2)] for w in [c * 3 for c in "abcdefgh"]}
    rows = []
    for i in range(120):
        w, out = "aaa", []
        for _ in range(80):
            out.append(w)
            w = r.choice(chain[w])
        rows.append((i, " ".join(out), "en", "s", 0))
    held = deleted_interpolation.score_documents(frame(spark, rows)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_interpolation_on_hard_and_empty_tables(docs, none):
    got = deleted_interpolation.score_documents(docs).collect()
    assert len(got) == len(hard_rows())
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert deleted_interpolation.score_documents(none).count() == 0


def test_weights_without_events_are_still_a_mixture():
    assert np.allclose(deleted_interpolation.mixture_weights([], 0).sum(1), 1)


# 2 -------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows = [(i, t, lang, None if i % 11 == 0 else ("big" if i % 3 else f"s{i % 7}"), n) for i, t, lang, _, n in prose(300)]
    got = source_mix.mix_sources(frame(spark, rows)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 200
    again = {r["doc_id"]: r["taken"] for r in source_mix.mix_sources(frame(spark, rows[::-1])).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mixed_rows_repeat_what_the_mix_takes(spark, docs):
    taken = Counter()
    for r in source_mix.mix_sources(docs).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    rows = source_mix.mixed_rows(docs)
    assert rows.columns == docs.columns
    found = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in rows.collect())
    assert found == +taken


def test_repeated_rows_are_taken_one_by_one(spark):
    same = " ".join(["word"] * 100)
    rows = [(1, same, "en", "a", 0)] * 40 + [(2, "some few words", "en", "a", 0), (3, "", "en", "a", 0), (3, None, "en", "a", 0)] + [(10 + i, same, "en", "b", 0) for i in range(60)]
    got = source_mix.mix_sources(frame(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["copies"] <= 3
    assert all(abs(taken[s] - target[s]) <= 50 for s in "ab") and len({r["copies"] for r in got if r["doc_id"] == 1}) == 2
    again = Counter((r["doc_id"], r["taken"]) for r in source_mix.mix_sources(frame(spark, rows[::-1]).repartition(3)).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in got)
    # A source at its cap, with rows that hold no word: nothing goes beyond its epochs.
    full = [(i, "one two three", "en", "a", 0) for i in range(3)] + [(10 + i, None, "en", "a", 0) for i in range(9)] + [(100 + i, same, "en", "b", 0) for i in range(9)]
    assert max(Counter(r["doc_id"] for r in source_mix.mixed_rows(frame(spark, full)).collect()).values()) <= 3
    duck = duckdb.connect()
    for table in (rows, full):
        documents = pd.DataFrame(table, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
        want = Counter(duck.sql(source_mix.ORACLE).fetchall())
        found = source_mix.mix_sources(frame(spark, table, extra=False)).select("doc_id", "size", "source_size", "target", "taken")
        assert Counter(tuple(r) for r in found.collect()) == want


def test_mix_of_an_empty_table(none):
    assert source_mix.mix_sources(none).count() == 0 and source_mix.mixed_rows(none).count() == 0


# 3 -------------------------------------------------------------------------------


def test_licenses_are_found_and_named():
    text = "Some prose.\nReleased under the MIT License.\nMore.\nLicensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."
    blocks, found = license_scan.scan(text)
    assert blocks >= 2 and [m.license for m in found] == ["MIT", "CC-BY-NC-4.0", "GPL-3.0"]
    assert all(text[m.start : m.stop] in text and m.missing == m.added == "" for m in found)


def test_license_differences_decide():
    assert [m.license for m in license_scan.scan("Licensed under CC BY 4.0.")[1]] == ["CC-BY-4.0"]
    changed = license_scan.scan("Permission is hereby granted, free of charge, to any human obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.")[1]
    assert [(m.license, m.missing, m.added) for m in changed] == [("MIT", "person", "human")]
    assert license_scan.scan("The licensed plumber signed the copyright form and left.")[1] == []


def test_license_in_a_very_long_line():
    text = "word " * 50_000 + "end. Released under the MIT License. " + "word " * 50_000
    assert [m.license for m in license_scan.scan(text)[1]] == ["MIT"]


def test_licenses_wrapped_over_lines():
    mit = next(t for name, t in license_scan.TEMPLATES if name == "MIT" and t.startswith("Permission"))
    w = mit.split(" ")
    wrapped = "int x;\n" + "".join(f" * {' '.join(w[i : i + 5])}\n" for i in range(0, len(w), 5)) + " */\nint y;"
    blocks, found = license_scan.scan(wrapped)
    assert [(m.license, m.missing, m.added) for m in found] == [("MIT", "", "")] and blocks == 1
    assert wrapped[found[0].start :].startswith("Permission") and wrapped[: found[0].stop].endswith("restriction")
    assert [m.license for m in license_scan.scan("ALL RIGHTS\nRESERVED.")[1]] == ["proprietary"]


def test_every_license_of_a_line_is_found():
    text = "Released under the MIT License. All rights reserved. Licensed under CC BY 4.0. Released under the MIT License."
    assert [m.license for m in license_scan.scan(text)[1]] == ["MIT", "proprietary", "CC-BY-4.0", "MIT"]
    assert license_scan.scan(" ".join([text] * 300))[1][-1].stop == len(text) * 300 + 298


def test_every_license_with_few_changes_is_found():
    r = random.Random(4)
    for k in r.sample(range(len(license_scan.TEMPLATES)), 300):
        template = license_scan.TEMPLATES[k][1]
        want = license_scan.words(template)
        for _ in range(20):
            have = list(want)
            for _ in range(len(want) // 10):
                if r.random() < 0.5:
                    del have[r.choice([i for i, w in enumerate(have) if not re.search("[0-9]", w)])]
                else:
                    have.insert(r.randrange(len(have) + 1), "zzz")
            found = license_scan.places(["x"] * r.randint(0, 3) + have + ["x"] * r.randint(0, 3))
            assert any(p.template == k for p in found)


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("This program is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0"),
        ("This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC-BY-SA-3.0"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org", "EPL-2.0"),
        (license_texts._BSD, "BSD-2-Clause"),
        (license_texts._BSD + license_texts._ENDORSING.replace("the copyright holder", "Example Corp"), "BSD-3-Clause"),
    ],
)
def test_common_licenses_are_named(text, name):
    assert [m.license for m in license_scan.scan(text)[1]] == [name]


def test_every_wording_is_named_by_its_license():
    for name, template in [*license_texts.PARAGRAPHS, *random.Random(2).sample(license_texts.TEMPLATES, 400)]:
        assert [m.license for m in license_scan.scan(f"Above.\n{template}\nbelow")[1]] == [name], template


def brute_scan(text, most_changed=0.1):
    """Every template tried at every word; of places that touch, those whose template compresses all their words best, one after another."""
    have = license_scan.words(text)
    places = set()
    for k, (_, template) in enumerate(license_scan.TEMPLATES):
        want = tuple(license_scan.words(template))
        most = int(most_changed * len(want) + 1e-9)
        if not set(want) & set(have) or len(set(want) - set(have)) > most:
            continue
        for start in range(len(have)):
            first, end, missing, added = license_scan.differences(have[start : start + len(want) + 2 * most], want)
            if end and len(missing) + len(added) <= most and not any(re.search("[0-9]", w) for w in missing):
                places.add((start + first, start + end, k, len(missing) + len(added)))
    chosen, left = [], sorted(places)
    while left:
        group, end = [left[0]], left[0][1]
        for x in left[1:]:
            if x[0] < end:
                group.append(x)
                end = max(end, x[1])
        together = have[group[0][0] : end]
        left = [x for x in left if x not in group]
        gain = {k: license_scan.saved(together, k)[0] for k in {x[2] for x in group}}
        while group:
            best = min(group, key=lambda x: (-gain[x[2]], x[3], x[0], x[2]))
            chosen.append((best[0], license_scan.TEMPLATES[best[2]][0]))
            group = [x for x in group if x[1] <= best[0] or x[0] >= best[1]]
    return [name for _, name in sorted(chosen)]


def test_scan_equals_every_template_at_every_word():
    r = random.Random(9)
    short = [t for _, t in license_scan.TEMPLATES if 3 <= len(license_scan.words(t)) <= 30]
    for _ in range(12):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(" ".join(r.choice(["the", "license", "of", "copyright", "plain", "words", "version", "is"]) for _ in range(r.randint(0, 6))))
            w = r.choice(short).split(" ")
            if r.random() < 0.5 and len(w) > 9:
                w[r.randrange(len(w))] = "zzz"
            parts.append(r.choice([" ", "\n// "]).join(w))
        text = "\n".join(parts)
        assert [m.license for m in license_scan.scan(text)[1]] == brute_scan(text), text


def test_every_block_is_compressed_with_every_template():
    """The nearest template of a block by brute force, found in it or not."""
    r = random.Random(5)
    for k in r.sample(range(len(license_scan.TEMPLATES)), 8):
        w = license_scan.TEMPLATES[k][1].split(" ")
        del w[:: r.choice([4, 6, 8])]
        text = f"Copyright notice, {' '.join(w)}"
        blocks, _ = license_scan.scan_blocks(text)
        have = license_scan.words(text)
        gains = [license_scan.saved(have, i) for i in range(len(license_scan.TEMPLATES))]
        gone = lambda i, have=have: (Counter(license_scan.words(license_scan.TEMPLATES[i][1])) - Counter(have)).total()
        best = min(range(len(gains)), key=lambda i: (-gains[i][0], gone(i), i))
        (near,) = license_scan.nearest(text, blocks)
        assert (near.license, near.reduction) == (license_scan.TEMPLATES[best][0], round(gains[best][1], 4)), text


@pytest.mark.parametrize(
    ("text", "name", "missing"),
    [
        ("// GNU LESSER GENERAL PUBLIC LICENSE\n// Version 2.1, February 1999", "LGPL-2.1", "licensed under v2.1"),
        ("Permission is hereby granted, of charge, to any person obtaining copy of this software and associated files, to deal in the Software restriction.", "MIT", "free a documentation without"),
        ("Licenced by the Creative folk, Attribution-ShareAlike 4.0, International Licence", "CC-BY-SA-4.0", "this work is licensed under a creative commons license"),
    ],
)
def test_license_in_other_words_is_told_as_the_nearest(text, name, missing):
    blocks, found = license_scan.scan_blocks(text)
    (near,) = license_scan.nearest(text, blocks)
    assert not found and (near.license, near.missing) == (name, missing) and near.reduction > 0.4


def test_every_notice_of_a_long_block_is_ranked():
    apart = "licensed words of no notice at all "
    text = apart * 60 + "Permission is hereby granted, of charge, to any person obtaining copy of this software and associated files, to deal in the Software restriction. " + apart * 60 + "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, " + apart * 60
    blocks, found = license_scan.scan_blocks(text)
    assert len(blocks) == 1 and not found and {"MIT", "LGPL-2.1"} <= {m.license for m in license_scan.nearest(text, blocks)}
    assert license_scan.nearest("license " + "ab+" * 9_000, [(0, 27_008)]) == []


def test_every_id_of_an_spdx_expression_is_named():
    text = "x\n# SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0) OR LicenseRef-x OR bsd-3-clause\nor ISC"
    found = license_scan.scan(text)[1]
    assert [m.license for m in found] == ["MIT", "Apache-2.0", "GPL-2.0", "BSD-3-Clause"] and text[found[1].start : found[1].stop] == "Apache-2.0"
    assert [m.license for m in license_scan.scan("SPDX-License-Identifier: LicenseRef-x AND MIT")[1]] == ["MIT"]


def test_nearest_templates_stand_in_the_table(spark):
    df = spark.createDataFrame([(1, "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"), (2, None), (3, "plain words")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.scan_documents(df).collect()}
    assert [m["license"] for m in rows[1]["nearest"]] == ["LGPL-2.1"] and rows[1]["matches"] == rows[2]["nearest"] == rows[3]["nearest"] == []


def test_license_words_take_linear_time():
    for t in ("-" * 300_000, "a." * 150_000, "license " * 50_000):
        license_scan.scan(t)


def test_license_tables(docs, none):
    assert license_scan.scan_documents(docs).count() == len(hard_rows()) and license_scan.scan_documents(none).count() == 0


# 4 and 6 -------------------------------------------------------------------------

ALPHABET = ["a", "b", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'", "'s", "'t", "'re", "don't", "1", "23", "é", "ß", "€", "中", "文", "😀", "\xa0", "　", "!", '"', "“", "<|endoftext|>", "<|endo", "_", "-", "\x0b", "\x1c", "\x85", "\x00", "İ", "ﬁ", "́", "½"]


def test_bpe_equals_the_library():
    library, own = Tokenizer.from_file(VOCABULARY), bpe.coder(VOCABULARY)
    r = random.Random(0)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [t or "" for _, t, *_ in hard_rows()]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == t


def test_bpe_batches_and_bounded_memory():
    own = bpe.ForcedBoundaryBPE(VOCABULARY, most_bytes=3_000)
    texts = [t.encode() for _, t, *_ in prose(40)] + [b"", b"a"]
    for _ in range(2):
        ids, counts = own.encode_batch(texts)
        assert own.decode(ids) == "".join(t.decode() for t in texts) and counts[-2:].tolist() == [0, 1]
    assert own.encode_batch([])[0].size == 0


def test_decoding_what_is_no_utf8():
    library, own = Tokenizer.from_file(VOCABULARY), bpe.coder(VOCABULARY)
    for ids in ([222], [98, 222, 98], [47249], [50256, 222, 223, 250]):
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_tables(docs, none):
    rows = bpe.decode_documents(bpe.encode_documents(docs, VOCABULARY), VOCABULARY).collect()
    assert sorted((r["decoded"] for r in rows)) == sorted(t or "" for _, t, *_ in hard_rows())
    assert bpe.decode_documents(bpe.encode_documents(none, VOCABULARY), VOCABULARY).count() == 0
    apart = {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows}
    assert {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe.code_documents(docs, VOCABULARY).collect()} == apart
    assert bpe.code_documents(none, VOCABULARY).count() == 0


def test_slices_hold_every_row_once():
    texts = ["a" * 10, None, "b" * 300, "", "c" * 60, "d" * 60, "é" * 20, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(8))], ["text", "n"])
    for most in (1, 50, 120, 10_000):
        parts = list(bpe.slices(batch, most=most))
        assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(8))
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= most for p in parts)
    assert list(bpe.slices(batch.slice(0, 0))) == []


def test_token_cache(spark, docs, none, tmp_path, monkeypatch):
    library, cache = Tokenizer.from_file(VOCABULARY), str(tmp_path / "cache")
    got = token_cache.count_tokens(docs, VOCABULARY, cache).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in hard_rows())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, *_ in hard_rows()})
    more = frame(spark, [*hard_rows(), (50, "something new", None, None, 0)])
    assert token_cache.count_tokens(more, VOCABULARY, cache).count() == len(hard_rows()) + 1
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_cache.count_tokens(none, VOCABULARY).count() == 0
    # What is stored is believed: no content that the cache holds is encoded again.
    version = token_cache.tokenizer_digest(VOCABULARY)
    false = spark.createDataFrame([(hashlib.sha256(b"something old").digest(), 777)], token_cache.CACHE_SCHEMA)
    false.write.mode("append").parquet(f"{cache}/tokenizer_digest={version}")
    old = frame(spark, [(60, "something old", None, None, 0), (61, "something old", None, None, 0), (62, "something else", None, None, 0)])
    assert [r["n_tokens"] for r in token_cache.count_tokens(old, VOCABULARY, cache).orderBy("doc_id").collect()] == [777, 777, 2]
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert token_cache.read_cache(spark, cache, "another version") is None and token_cache.read_cache(spark, cache, token_cache.tokenizer_digest(other)) is not None


def test_spread_join_loses_and_adds_nothing(spark):
    keys = [None if k % 50 == 7 else (b"hot" if k % 3 == 0 else f"k{k % 400}".encode()) for k in range(3000)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(keys)], "id int, key binary").repartition(5)
    table = spark.createDataFrame([(x, i) for i, x in enumerate(sorted({x for x in keys if x and x != b"k11"}))], "key binary, v int")
    value = {bytes(r["key"]): r["v"] for r in table.collect()}
    hot = hot_keys(rows, "key", most=100)
    assert [bytes(k) for k, _ in hot] == [b"hot"] and hot[0][1] > 30
    got = sorted((r["id"], r["v"]) for r in join_spread(rows, table, "key", hot).collect())
    assert got == [(k, value[x]) for k, x in enumerate(keys) if x in value]
    got = sorted((r["id"], r["v"]) for r in join_spread(rows, table, "key", hot, "left").collect())
    assert got == [(k, value.get(x)) for k, x in enumerate(keys)]
    assert hot_keys(rows.where("false"), "key") == [] and join_spread(rows.where("false"), table, "key", hot).count() == 0


# 5 -------------------------------------------------------------------------------


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_text_statistics(spark):
    r = random.Random(2)
    texts = [t for _, t, *_ in hard_rows()] + ["".join(r.choice(["a ", "b ", "c\n", "#", "é ", "|", "\n", " "]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    for x in decision_list.judge_quality(df, []).collect():
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == brute_statistics(texts[x["doc_id"]])
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]) and x["kept"] == (not x["base_failed"])


def test_base_columns_equal_sql(spark):
    rows = [r for r in hard_rows() if r[0] not in (None, 6)] + [(100 + i, *x) for i, *x in prose(40, vocabulary=12)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    want = sorted(duckdb.sql(decision_list.BASE_ORACLE).fetchall())
    got = decision_list.judge_quality(frame(spark, rows), []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect())) == want


def test_false_neighbours_fall_back_to_words(spark, monkeypatch):
    monkeypatch.setattr(decision_list, "_PLACE_BITS", 24)
    texts = ["a b c a b c d", "a b c d e f g"]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], extra=False)
    d = decision_list.text_statistics(df)
    assert [r["n_repeat_words"] for r in d.orderBy("doc_id").collect()] == [6, 0]


def test_decision_list_learns_what_is_bad(spark):
    rows, labels, r = prose(400), [], random.Random(3)
    for i, row in enumerate(rows):
        bad = i % 4 == 0
        rows[i] = (i, " ".join(w + "###" for w in row[1].split()) if bad else row[1], *row[2:])
        labels.append((i, 0 if bad else 1, r.randint(0, 1)))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rules = decision_list.learn(*decision_list.labelled_cells(docs, lab))
    assert rules
    got = {x["doc_id"]: x["kept"] for x in decision_list.judge_quality(docs, rules).collect()}
    assert got == {i: i % 4 != 0 for i in range(400)}
    kept = decision_list.kept_documents(docs, rules)
    assert kept.columns == docs.columns and kept.count() == 300 and kept.where("n_words = 'clash'").count() == 300


def test_decision_list_without_labels(spark, docs, none):
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert decision_list.learn(*decision_list.labelled_cells(docs, lab)) == []
    assert decision_list.kept_documents(none, []).count() == 0


# 7 -------------------------------------------------------------------------------


def naive_spans(t):
    found = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or (k == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (k == "card" and 12 <= len(d) <= 19 and semicrf_pii.luhn(d)) or (k == "phone" and 9 <= len(d) <= 15):
                found.append((k, *m.span()))
    return sorted(found, key=lambda s: (s[1], semicrf_pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    parts = ["a", "b.", "@", "@a.b", "1", "12", "255", ".", "..", "-", " ", "+", "+1 (55", "4111111111111111", "4111 1111-1111 1111", "é", "192.168.1.1", "(", ")", "%", "_"]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert semicrf_pii.base_spans(t) == naive_spans(t)


def test_base_spans_take_linear_time():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000):
        semicrf_pii.base_spans(t)


def cases(n=60, seed=5):
    r, out = random.Random(seed), []
    for _ in range(n):
        who, d = r.choice(["ann", "bo.li", "c-d"]), "".join(r.choice("0123456789") for _ in range(7))
        out += [f"write to {who}@site{r.randint(1, 9)}.org today or", f"call +1 (2{d[:2]}) 555-{d[2:6]} now and", f"from host 10.{r.randint(0, 255)}.3.{r.randint(0, 255)} the", "card 4111 1111 1111 1111 was used"]
    return out


@pytest.fixture(scope="module")
def field():
    return semicrf_pii.train(cases(), epochs=4)


def test_field_adds_spans_and_keeps_base_ones(field):
    t = "mail john.doe [at] example.com or call (555) 123-4567, not ann@b.org"
    base, all_ = semicrf_pii.all_spans(t, field)
    assert base == naive_spans(t) and set(base) <= set(all_)
    assert {(k, t[a:b]) for k, a, b in all_} >= {("email", "john.doe [at] example.com"), ("phone", "(555) 123-4567"), ("email", "ann@b.org")}
    assert semicrf_pii.all_spans("on 2024-01-05 12:35 we paid 4500.20", field)[1] == []


@pytest.mark.parametrize("text", ["from 1999-12-31 to 2000-01-01 there", "at 12:35:10 on 05.01.2024 it", "on 05-01-2024 10:00-12:30 we", "from 1914-1918 and 1939-1945", "in 2023 2024 2025 the", "done 2024-01-05 12-35 and", "log 2024-01-05T12:35:10 ok"])
def test_dates_are_no_personal_data(field, text):
    assert semicrf_pii.all_spans(text, field)[1] == []


@pytest.mark.parametrize(
    "mail",
    [
        "jane.doe (at) mail [dot] example [dot] com",
        "jane.doe [at] cs [dot] example [dot] edu",
        "j.doe (at) example (dot) co (dot) uk",
        "jane at example dot com",
        "JANE (AT) EXAMPLE (DOT) COM",
        "a" * 60 + " [at] " + "b" * 60 + ".example.com",
        "j-" * 40 + "doe (at) " + "x [dot] " * 20 + "com",
    ],
)
def test_long_addresses_are_found_whole(field, mail):
    t = f"please write to us, {mail}, or come by"
    assert ("email", mail) in {(k, t[a:b]) for k, a, b in semicrf_pii.all_spans(t, field)[1]}


def test_rare_personal_data_is_learned_from(spark):
    rows = [(i, f"on 20{i % 90 + 10}-01-{i % 28 + 1:02} we paid {i}.50 for {i + 3} of them", None, None, None) for i in range(3000)]
    rows += [(3000, "write to ann@site.org today", None, None, None), (3001, "call +1 (212) 555-1234 now", None, None, None)]
    found = semicrf_pii.training_windows(frame(spark, rows))
    assert len(found) <= 400 and {k for x in found for k, _, _ in semicrf_pii.base_spans(x)} == {"email", "phone"}
    only = frame(spark, [(1, "mail john.doe [at] example.com now", None, None, None)])
    assert [r["spans"][0]["kind"] for r in semicrf_pii.find_personal_data(only, semicrf_pii.train(semicrf_pii.training_windows(only))).collect()] == ["email"]
    again = semicrf_pii.training_windows(frame(spark, rows[::-1]).repartition(7))
    assert found == again


def test_kinds_without_samples_are_learned_from_generated_forms():
    r = random.Random(1)
    assert all([x[0] for x in semicrf_pii.base_spans(semicrf_pii.generated(k, r))] == [k] for k in semicrf_pii.KINDS for _ in range(50))
    field = semicrf_pii.train([f"on 2024-01-{i:02} we paid {i}.50" for i in range(1, 29)])
    t = "mail john.doe [at] example.com or call (555) 123-4567 now"
    assert {("email", "john.doe [at] example.com"), ("phone", "(555) 123-4567")} <= {(k, t[a:b]) for k, a, b in semicrf_pii.all_spans(t, field)[1]}


def test_windows_take_linear_time():
    for t in ("a" * 300_000 + "1", "a." * 30_000 + "@", " at b dot" * 10_000, "1 " + "x" * 300_000):
        semicrf_pii.windows(t)


def test_gradients_of_the_field():
    r = np.random.default_rng(0)
    f = semicrf_pii.Field.new()
    f.spans += r.normal(0, 0.3, f.spans.shape)
    f.turns += r.normal(0, 0.3, f.turns.shape)
    t = "call +1 (234) 555-1234 now"
    tokens, found, rows = semicrf_pii.laid_out(t, 0, len(t))
    gold = {found[len(found) // 2]: 4}
    value, gs, gt = semicrf_pii.likelihood(f, len(tokens), found, rows, gold)
    assert value < 0
    for array, grad, at in ((f.spans, gs, (4, 10)), (f.spans, gs, (2, 0)), (f.turns, gt, (0, 4)), (f.turns, gt, (4, 0))):
        array[at] += 1e-5
        up = semicrf_pii.likelihood(f, len(tokens), found, rows, gold)[0]
        array[at] -= 2e-5
        down = semicrf_pii.likelihood(f, len(tokens), found, rows, gold)[0]
        array[at] += 1e-5
        assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_best_path_is_the_best_of_all_paths(field):
    t = "x (555) 123-4567 y"
    tokens, found, rows = semicrf_pii.laid_out(t, 0, len(t))
    scores = rows @ field.spans.T
    best = (-math.inf, None)

    def walk(i, y, value, path):
        nonlocal best
        if i == len(tokens):
            best = max(best, (value, tuple(path)))
            return
        walk(i + 1, 0, value + field.turns[y, 0], path)
        for s, (a, b) in enumerate(found):
            if a == i:
                for k in range(1, 5):
                    walk(b, k, value + field.turns[y, k] + scores[s, k], [*path, (a, b, k)])

    walk(0, 0, 0.0, [])
    assert tuple(semicrf_pii.best_path(field, len(tokens), found, rows)) == best[1]


def test_personal_data_tables(spark, docs, none, field):
    rows = semicrf_pii.find_personal_data(docs, field).collect()
    assert len(rows) == len(hard_rows()) and semicrf_pii.find_personal_data(none, None).count() == 0
    assert semicrf_pii.train(semicrf_pii.training_windows(none)) is None
    mails = frame(spark, [(1, "to a@b.cd now", None, None, None), (2, None, None, None, None)])
    clean = semicrf_pii.redact_documents(mails, field)
    assert clean.columns == mails.columns and [r["text"] for r in clean.orderBy("doc_id").collect()] == ["to [EMAIL] now", None]
    assert semicrf_pii.redacted("abcdef", [("card", 1, 3), ("phone", 2, 5)]) == "a[CARD]f"


# 8 -------------------------------------------------------------------------------


def test_chunks_follow_the_content():
    r = random.Random(6)
    a = bytes(r.randrange(256) for _ in range(60_000))
    chunks = media_chunks.chunked(a)
    assert b"".join(chunks) == a and all(media_chunks.LEAST <= len(c) <= media_chunks.MOST for c in chunks[:-1])
    moved = media_chunks.chunked(b"some bytes before" + a)
    assert len(set(moved) & set(chunks)) > 0.9 * len(chunks)
    assert media_chunks.chunked(b"") == [b""] and b"".join(media_chunks.chunked(b"x" * 99_999)) == b"x" * 99_999


def test_media_read_back(spark, none):
    rows = hard_rows() + prose(30) + [(70 + i, t + " tail", *x) for i, t, *x in prose(30)]
    packs, chunks = media_chunks.store_media(frame(spark, rows))
    got = media_chunks.read_media(packs, chunks).collect()
    assert chunks.count() == chunks.select("digest").distinct().count() > 0
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        pad = raw + b" " * (max(1, math.ceil(len(raw) / 192)) * 192 - len(raw))
        want.append((-1 if i is None else i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:])))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    by_payload = defaultdict(set)
    for r in got:
        by_payload[r["payload_sha256"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by_payload.values())
    assert media_chunks.read_media(*media_chunks.store_media(none)).count() == 0


def test_a_full_filter_only_moves_chunks(spark):
    docs = frame(spark, hard_rows() + prose(20))
    texts = media_chunks.waves(docs)
    key = lambda rows: sorted((r["payload_sha256"], r["media_sha256"], r["n_bytes"]) for r in rows)
    want = key(media_chunks.read_media(*media_chunks.store_media(docs)).collect())
    packs = media_chunks.packed_media(texts, np.full(16, 2**64 - 1, np.uint64)).cache()
    chunks = packs.select(F.explode("shared").alias("c")).select("c.digest", "c.bytes").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    assert packs.where("whole").count() == 0 and key(media_chunks.read_media(packs, chunks).collect()) == want
    assert [media_chunks.filter_bits(n) for n in (0, 100, 10**6, 10**12)] == [10, 11, 24, 27]


def test_damaged_media_are_noticed(spark):
    packs, chunks = media_chunks.store_media(frame(spark, prose(3)))
    bad = packs.withColumn("media_sha256", F.lit("0" * 64))
    with pytest.raises(Exception, match="does not read back"):
        media_chunks.read_media(bad, chunks).count()


# 9 -------------------------------------------------------------------------------


def brute_components(rows, width, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(lowered(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies_of(base, n, seed, most):
    r, out = random.Random(seed), []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    rows = [r for r in hard_rows() if r[0] != 6 and r[0] is not None] + [(20, "one two three four", *[None] * 3), (21, "one two three four five", *[None] * 3), (22, "One TWO three four", *[None] * 3)]
    at = 100
    for k, (i, t, *x) in enumerate(prose(25, seed=9)):
        for c in copies_of(t, 12 if k < 8 else 1, k, 7):
            rows.append((at, c, *x))
            at += 1
    random.Random(1).shuffle(rows)
    want = brute_components(rows, width)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setsketch.near_duplicates(frame(spark, rows), width=width).collect()}
    assert got == want
    kept = {r["doc_id"] for r in setsketch.near_duplicates(frame(spark, rows), width=width).where("kept").collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_of_hard_and_empty_tables(docs, none):
    rows = setsketch.near_duplicates(docs, width=2).collect()
    assert len(rows) == len(hard_rows())
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True]
    assert setsketch.near_duplicates(none).count() == 0


def test_registers_merge_and_tell_similarity():
    r = np.random.default_rng(1)
    items = r.integers(0, 1 << 63, 1300, dtype=np.uint64)
    a, b = items[:1200], items[100:]
    ka, kb = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merged(ka, kb) == setsketch.registers(items)).all()
    truth = 1100 / 1300
    got = setsketch.joint_estimate(ka[None], kb[None], np.array([1200.0]), np.array([1200.0]))[0]
    assert abs(got - truth) < 0.12


def test_components_of_a_path_and_a_star(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(50)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in setsketch.components(edges).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[1000 + i] for i in range(51)}) == 1 and roots[0] != roots[1000]


# 10 ------------------------------------------------------------------------------


def speech(n, seed=2):
    r, out = random.Random(seed), []
    parts = {"en": ["the", "of", "thing", "wh", "ough"], "de": ["der", "sch", "ung", "heit", "ß"], "fr": ["le", "eaux", "que", "é", "oi"]}
    for i in range(n):
        lang = list(parts)[i % 3]
        out.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(40)), lang, "s", 0))
    return out


def test_language_of_held_out_documents(spark):
    rows = speech(240)
    docs = frame(spark, rows)
    net = bigru_lang.train(bigru_lang.training_stretches(docs))
    got = {r["doc_id"]: r for r in bigru_lang.predict(docs, net).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["n_agreeing"] <= r["n_positions"] for r in got.values())
    learned = [r[1] for r in rows if r not in held]
    sample = bigru_lang.training_stretches(docs, per_language=50)
    assert all(any(x in t for t in learned) for _, x in sample) and Counter(lang for lang, _ in sample) == {"de": 50, "en": 50, "fr": 50}
    assert sample == bigru_lang.training_stretches(docs.repartition(5), per_language=50)


def naive_distribution(net, text):
    """Mean of the distributions at all positions, one position after another; and how many positions each language is first at."""
    w, x = {k: v.astype(float) for k, v in net.w.items()}, text.lower().encode()
    H = w["Whf"].shape[0]
    bent = lambda v: v / (1 + abs(v))
    states = {}
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h = np.zeros(H)
        for t in order:
            a, g = w["E"][x[t]] @ w[f"Wx{d}"] + w[f"bx{d}"], h @ w[f"Wh{d}"]
            z, r = (0.5 + 0.5 * bent(a[k * H : (k + 1) * H] + g[k * H : (k + 1) * H]) for k in (0, 1))
            h = z * h + (1 - z) * bent(a[2 * H :] + r * g[2 * H :])
            states[d, t] = h
    p = [bigru_lang._softmax(np.concatenate([states["f", t], states["b", t]]) @ w["Wo"] + w["bo"]) for t in range(len(x))]
    return np.mean(p, axis=0), Counter(int(v.argmax()) for v in p)


def test_predictions_equal_reading_byte_by_byte(spark):
    rows = speech(90)
    net = bigru_lang.train([(r[2], r[1][:80]) for r in rows], epochs=3)
    texts = [r[1][: 7 * i + 1] for i, r in enumerate(rows[:30])] + ["é", "a" * 255, "b" * 256, "ab" * 128 + "c"]
    wide = bigru_lang.Reader(net, window=1 << 20)
    p, labels, n = wide.read(texts)
    for i, t in enumerate(texts):
        want, firsts = naive_distribution(net, t)
        assert np.allclose(p[i], want, atol=1e-5) and n[i] == len(t.lower().encode()) and dict(enumerate(labels[i])) == {y: firsts[y] for y in range(3)}
    # Windows: as in one piece up to a window, very nearly so beyond.
    long = [" ".join(r[1] for r in rows[k::3]) for k in range(3)] + texts
    a, b = bigru_lang.Reader(net).read(long)[0], wide.read(long)[0]
    assert np.abs(a - b).max() < 0.01 and (a.argmax(1) == b.argmax(1)).all()
    assert np.allclose(a[3:], b[3:], atol=1e-5) or max(map(len, texts)) > bigru_lang.WINDOW
    got = {r["doc_id"]: r for r in bigru_lang.predict(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), net).collect()}
    assert all(got[i]["score"] == pytest.approx(p[i].max(), abs=0.01) and got[i]["lang_pred"] == net.languages[p[i].argmax()] for i in range(len(texts)))


def test_gradients_of_the_network():
    net = bigru_lang.BiGRU.new(["a", "b"], embed=3, hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, m = bigru_lang.packed([b"abc", b"de"])
    y = np.array([0, 1])
    _, g = net.gradients(x, m, y)
    for name, at in (("E", (97, 1)), ("Wxf", (1, 2)), ("Whf", (0, 9)), ("Whb", (2, 1)), ("Wo", (5, 1)), ("bxb", (3,)), ("bo", (0,))):
        net.w[name][at] += 1e-4
        up = net.gradients(x, m, y)[0]
        net.w[name][at] -= 2e-4
        down = net.gradients(x, m, y)[0]
        net.w[name][at] += 1e-4
        assert g[name][at] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_language_tables(spark, docs, none):
    net = bigru_lang.train([("en", "the"), ("en", "that"), ("de", "über"), ("de", "größe")] * 5, epochs=2)
    rows = {(r["doc_id"], r["lang_pred"]) for r in bigru_lang.predict(docs, net).collect()}
    assert {i for i, p in rows if p == "und"} == {1, 2, 3, 9}
    assert bigru_lang.train(bigru_lang.training_stretches(none)) is None
    assert {r["lang_pred"] for r in bigru_lang.predict(docs, None).collect()} == {"und"} and bigru_lang.predict(none, net).count() == 0


def test_near_duplicates_by_names(spark):
    rows = prose(30) + [(100 + i, prose(3)[0][1] + " more", "en", "a", 0) for i in range(3)] + hard_rows()
    docs = frame(spark, rows)
    named = docs.withColumn("name", F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 6, "0")))
    back = lambda x: None if x is None else int(x[1:])
    got = [(back(r["doc_id"]), r["n_shingles"], back(r["component_id"]), r["kept"]) for r in setsketch.near_duplicates(named, 2, id_col="name").collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, setsketch.near_duplicates(docs, 2).collect()), key=repr)


def test_language_sample_is_cut_in_spark(spark):
    rows = [(7, f"stretch number {i} of many words", "en", "a", 0) for i in range(3000)] + [(8 + i, f"rare {i} language", f"l{i}", "a", 0) for i in range(300)]
    sample = bigru_lang.training_stretches(frame(spark, rows), per_language=50)
    langs = Counter(lang for lang, _ in sample)
    assert max(langs.values()) <= 50 and {f"l{i}" for i in range(300) if zlib.crc32(str(8 + i).encode()) % 5} <= set(langs)
    assert max(Counter(lang for lang, _ in bigru_lang.training_stretches(frame(spark, rows), most=300)).values()) == 1
