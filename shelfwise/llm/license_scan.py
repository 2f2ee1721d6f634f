"""License scan by conditional compression.

Words are compared without regard to case, line breaks and comment marks.  A
template that is found with at most k words missing or added holds one of its
k + 1 pieces unchanged, so every place around such a piece is aligned with the
whole template, and none is missed.  Versions and other words with digits may
not be among the missing ones.  The words of places that overlap are compressed
alone and with each of their templates as a raw zstandard dictionary; the place
whose template saves most bytes is kept, until none is left.
Candidate blocks are runs of lines (or, in lines longer than any template, of
stretches) that hold a word of license notices or a place.  Every block is
compressed with every template, whether or not one is found in it: the one that
saves most is the nearest, told with its changed words however many they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .license_texts import TEMPLATES

#: What every notice of these kinds says somewhere, in lower case (fixed values).
HINTS = ("licens", "licenc", "copyright", "permission is hereby", "redistribution", "public domain", "all rights reserved", "creative commons", "cc by")

_WORDS = re.compile(r"\w++(?:[.+-]++\w++)*+")
_DIGIT = re.compile(r"[0-9]")
_LONGEST = max(len(t) for _, t in TEMPLATES)
MOST_CHANGED = 0.1


class Match(NamedTuple):
    license: str
    start: int
    stop: int
    reduction: float
    missing: str
    added: str


class Place(NamedTuple):
    """A template in a list of words: first and end word, words missing and added."""

    template: int
    first: int
    end: int
    missing: tuple[str, ...]
    added: tuple[str, ...]


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


@lru_cache(1)
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=6)


@lru_cache(1)
def _known() -> list[zstandard.ZstdCompressionDict]:
    return [zstandard.ZstdCompressionDict(" ".join(words(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in TEMPLATES]


def _given(template: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=6, dict_data=_known()[template])  # not kept: thousands of them would hold 100 KB each


@lru_cache(4)
def _pieces(most_changed: float) -> tuple[list[tuple[str, ...]], dict[str, list[tuple[int, int, int, int]]]]:
    """(words of every template, its pieces by the word that fewest templates hold: template, start, end, position of the word)."""
    wanted, by_word = [tuple(words(t)) for _, t in TEMPLATES], {}
    holding = Counter(w for want in wanted for w in set(want))
    for k, want in enumerate(wanted):
        n = _most(want, most_changed) + 1
        for i in range(n):
            a, b = i * len(want) // n, (i + 1) * len(want) // n
            at = max(range(a, b), key=lambda j: (len(want[j]) > 2, -holding[want[j]], len(want[j])))
            by_word.setdefault(want[at], []).append((k, a, b, at))
    return wanted, by_word


def _most(want: tuple[str, ...], most_changed: float) -> int:
    return int(most_changed * len(want) + 1e-9)


def candidate_blocks(text: str, places: Iterable[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Stretches that may hold a notice, and those of ``places``, joined where they touch; in code points, end exclusive."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer
        lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    found = [(i, i) for h in HINTS for i in _every(lower, h)]
    out: list[list[int]] = []
    for i, j in sorted({*found, *places}):
        low, high = max(0, i - 3 * _LONGEST), min(len(text), j + 3 * _LONGEST)
        a, b = text.rfind("\n", low, i) + 1 or low, text.find("\n", j, high)
        b = high if b < 0 else b
        if b - a > 2 * _LONGEST:
            a, b = max(a, i - _LONGEST), min(b, j + _LONGEST)
            if (dot := text.find(". ", a, i)) >= 0:
                a = dot + 2
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _every(text: str, part: str) -> Iterator[int]:
    i = text.find(part)
    while i >= 0:
        yield i
        i = text.find(part, i + len(part))


def saved(have: list[str], template: int) -> tuple[int, float]:
    """(bytes, share) by which words become smaller, compressed with a template."""
    raw = " ".join(have).encode()
    alone, less = len(_plain().compress(raw)), len(_given(template).compress(raw))
    return alone - less, 1 - less / alone


def differences(have: list[str], want: tuple[str, ...]) -> tuple[int, int, list[str], list[str]]:
    """(first word, end word, template words missing, words added) of the place of a template with fewest changes, none of them a missing digit if that can be."""
    n = len(have)
    price = [1_000 if _DIGIT.search(w) else 1 for w in want]
    rows = [[0] * (n + 1)]
    for i, w in enumerate(want):
        up, row = rows[-1], [rows[-1][0] + price[i]]
        for j, v in enumerate(have):
            row.append(up[j] if v == w else min(up[j + 1] + price[i], row[j] + 1))
        rows.append(row)
    end = min(range(n + 1), key=rows[-1].__getitem__)
    i, j, missing, added, kept = len(want), end, [], [], []
    while i:
        if j and have[j - 1] == want[i - 1]:
            i, j = i - 1, j - 1
            kept.append(j)
        elif not j or rows[i - 1][j] + price[i - 1] <= rows[i][j - 1] + 1:
            i -= 1
            missing.append(want[i])
        else:
            j -= 1
            added.append(j)
    if not kept:
        return 0, 0, list(want), []
    return kept[-1], kept[0] + 1, missing[::-1], [have[x] for x in reversed(added)]


def places(have: list[str], most_changed: float = MOST_CHANGED) -> set[Place]:
    """Every template wherever it is found with at most ``most_changed`` of its words missing or added."""
    wanted, by_word = _pieces(most_changed)
    out: set[Place] = set()
    whole: set[tuple[int, int]] = set()
    for i, w in enumerate(have):
        for k, a, b, at in by_word.get(w, ()):
            want, start = wanted[k], i - at
            if start + a < 0 or (k, start) in whole or tuple(have[start + a : start + b]) != want[a:b]:
                continue
            if start >= 0 and tuple(have[start : start + len(want)]) == want:
                whole.add((k, start))
                out.add(Place(k, start, start + len(want), (), ()))
            elif most := _most(want, most_changed):
                low = max(0, start - most)
                first, end, missing, added = differences(have[low : max(0, start + len(want) + most)], want)
                if len(missing) + len(added) <= most and not any(_DIGIT.search(w) for w in missing):
                    out.add(Place(k, low + first, low + end, tuple(missing), tuple(added)))
    return out


def _overlapping(found: set[Place]) -> Iterator[list[Place]]:
    """Groups of places that overlap, by their first word."""
    group: list[Place] = []
    end = 0
    for p in sorted(found, key=lambda p: (p.first, p)):
        if group and p.first >= end:
            yield group
            group = []
        group.append(p)
        end = max(end, p.end)
    if group:
        yield group


@lru_cache(1)
def _counted() -> list[Counter[str]]:
    return [Counter(words(t)) for _, t in TEMPLATES]


@lru_cache(2_048)
def nearest_template(have: tuple[str, ...]) -> tuple[int, float, int, int, str, str] | None:
    """(template, share saved, first and end word of its place, words missing, words added) of the template of all that saves most bytes; of equals the one with fewest words that are not here, then the first.  None if none saves any."""
    raw = " ".join(have).encode()
    alone = len(_plain().compress(raw))
    less = [len(_given(k).compress(raw)) for k in range(len(TEMPLATES))]
    least = min(less)
    if least >= alone:
        return None
    here = Counter(have)
    best = min((k for k, n in enumerate(less) if n == least), key=lambda k: ((_counted()[k] - here).total(), k))
    first, end, missing, added = differences(list(have), tuple(words(TEMPLATES[best][1])))
    return best, round(1 - least / alone, 4), first, end, " ".join(missing), " ".join(added)


def _stretches(text: str, start: int, stop: int) -> Iterator[list[tuple[int, int]]]:
    """Spans of a block's words, all at once if it is short; else stretches that overlap by the longest template, so that each notice is whole in one of them.  Words longer than any template are left out: no template holds them."""
    spans = [m.span() for m in _WORDS.finditer(text, start, stop)]
    spans = [x for x in spans if x[1] - x[0] <= _LONGEST]
    i = 0
    while i < len(spans):
        j = bisect_left(spans, (spans[i][0] + 2 * _LONGEST,))
        yield spans[i:j]
        if j == len(spans):
            return
        i = max(i + 1, bisect_left(spans, (spans[i][0] + _LONGEST,)))


def nearest(text: str, blocks: Iterable[tuple[int, int]]) -> list[Match]:
    """The nearest template of every block, each place once, by start: what stands in other words than its template, or with many of them changed, is told here."""
    out: set[Match] = set()
    for start, stop in blocks:
        for spans in _stretches(text, start, stop):
            found = nearest_template(tuple(text[a:b].lower() for a, b in spans))
            if found is not None:
                k, share, first, end, missing, added = found
                end = end or len(spans)  # nothing but parts of words in common
                out.add(Match(TEMPLATES[k][0], spans[first][0], spans[end - 1][1], share, missing, added))
    return sorted(out, key=lambda m: (m.start, m.stop, m))


@lru_cache(1)
def _spdx() -> dict[str, int]:
    """Templates of SPDX lines by their id."""
    return {w[1]: k for k, (_, t) in enumerate(TEMPLATES) if len(w := words(t)) == 2 and w[0] == "spdx-license-identifier"}


def _later_ids(text: str, have: list[str], spans: list[tuple[int, int]]) -> Iterator[Match]:
    """Ids of an SPDX expression behind its first, which is found as a template; exceptions (``WITH``) are no licenses."""
    for i, w in enumerate(have):
        j = i + 2
        while w == "spdx-license-identifier" and j + 1 < len(have) and have[j] in ("or", "and", "with") and "\n" not in text[spans[i][0] : spans[j + 1][0]]:
            k = _spdx().get(have[j + 1]) if have[j] != "with" else None
            if k is not None:
                yield Match(TEMPLATES[k][0], *spans[j + 1], round(saved([w, have[j + 1]], k)[1], 4), "", "")
            j += 2


def scan(text: str, most_changed: float = MOST_CHANGED) -> tuple[int, list[Match]]:
    """(candidate blocks, confirmed matches by their start) of ``scan_blocks``."""
    blocks, found = scan_blocks(text, most_changed)
    return len(blocks), found


def scan_blocks(text: str, most_changed: float = MOST_CHANGED) -> tuple[list[tuple[int, int]], list[Match]]:
    """(candidate blocks, confirmed matches by their start).

    Every template is compared everywhere.  Of places that overlap, the one
    whose template saves most bytes of them all is kept (then the one with
    fewest changed words, then the first), until none is left.  All ids of an
    SPDX expression are named.
    """
    have = words(text)
    taken: list[tuple[Place, float]] = []
    for group in _overlapping(places(have, most_changed)):
        together = have[group[0].first : max(p.end for p in group)]
        gains = {k: saved(together, k) for k in {p.template for p in group}}
        kept: list[Place] = []
        for p in sorted(group, key=lambda p: (-gains[p.template][0], len(p.missing) + len(p.added), p.first, p.template)):
            i = bisect_left(kept, p.first, key=lambda x: x.first)
            if (not i or kept[i - 1].end <= p.first) and (i == len(kept) or p.end <= kept[i].first):
                kept.insert(i, p)
        taken += [(p, gains[p.template][1]) for p in kept]
    expressions = "spdx-license-identifier" in have
    spans = [w.span() for w in _WORDS.finditer(text)] if taken or expressions else []
    out = [Match(TEMPLATES[p.template][0], spans[p.first][0], spans[p.end - 1][1], round(share, 4), " ".join(p.missing), " ".join(p.added)) for p, share in taken]
    if expressions:
        known = {(m.start, m.stop) for m in out}
        out = sorted([*out, *(m for m in _later_ids(text, have, spans) if (m.start, m.stop) not in known)], key=lambda m: m.start)
    return candidate_blocks(text, [(m.start, m.stop) for m in out]), out


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_blocks, matches, nearest) of every row.

    Null and empty texts have no blocks and empty lists; repeated rows give
    equal results; an empty table gives an empty one.
    """
    wanted = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    match = T.StructType([T.StructField(n, t) for n, t in zip(Match._fields, (T.StringType(), T.LongType(), T.LongType(), T.DoubleType(), T.StringType(), T.StringType()), strict=True)])
    schema = T.StructType([T.StructField("doc_id", wanted.schema["doc_id"].dataType), T.StructField("n_blocks", T.LongType()), T.StructField("matches", T.ArrayType(match)), T.StructField("nearest", T.ArrayType(match))])
    arrow = pa.list_(pa.struct(list(zip(Match._fields, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string()), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists = [], ([], [])
            for text in batch.column("text").to_pylist():
                blocks, matches = scan_blocks(text or "")
                counts.append(len(blocks))
                for told, ms in zip(lists, (matches, nearest(text or "", blocks)), strict=True):
                    told.append([m._asdict() for m in ms])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *[pa.array(told, arrow) for told in lists]], schema.names)

    return wanted.mapInArrow(run, schema)
