"""Personal data by fixed patterns and a semi-Markov conditional random field.

The fixed patterns give the base spans.  The random field adds spans that are
written in other ways: inside windows around digits and address signs it lists
candidate segments (addresses of any length, figures of at most as many digits
as a card has), scores each as a whole by features of the span, and a dynamic
programme over token positions picks boundaries and kinds together.  A segment
with an address sign that has not the form of an address is a candidate only up
to ``MOST_TOKENS`` tokens.  Weights are learned in numpy
from a bounded sample of windows whose base spans, and rewritten forms of them,
serve as labels.
"""

from __future__ import annotations

import heapq
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Kinds in their order (fixed values).
KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 20
#: Digits of the longest card, and its tokens with three marks between any two digits.
MOST_DIGITS, MOST_FIGURES = 19, 73
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive, and only from the start of a run of digits: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind; in code points, end exclusive."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            found.append(("email", start, done))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- candidates -------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")
_TRIGGER = re.compile(r"(?i)[0-9@]|[\[(] ?at ?[\])]| at (?=[a-z0-9-]+ dot )")
_REACH = 40
_INNER = frozenset("@.-+()[]_% :")


def _unbroken(c: str) -> bool:
    return c.isalnum() or (c != " " and c in _INNER)


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold a candidate: around every trigger and address, never ending inside a run of usable marks, merged where they meet."""
    near = [(max(0, m.start() - _REACH), min(len(text), m.end() + _REACH)) for m in _TRIGGER.finditer(text)]
    if not near:
        return []
    out: list[list[int]] = []
    for a, b in sorted(near + [m.span() for m in _MAIL.finditer(text)]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    wide: list[list[int]] = []
    for a, b in out:
        done = wide[-1][1] if wide else 0
        while a > done and _unbroken(text[a - 1]) and _unbroken(text[a]):
            a -= 1
        b = max(b, done)
        while b < len(text) and _unbroken(text[b - 1]) and _unbroken(text[b]):
            b += 1
        if wide and a <= done:
            wide[-1][1] = b
        else:
            wide.append([a, b])
    return [(a, b) for a, b in wide]


_AT = re.compile(r"(?i) ?[\[(] ?at ?[\])] ?| @ ?|@ ")
_MAIL = re.compile(
    r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:"
    r"(?:@| ?@ ?| ?[\[(] ?at ?[\])] ?)[a-z0-9-]++(?:(?:\.| ?[\[(] ?dot ?[\])] ?| dot )[a-z0-9-]++)+"
    r"| at [a-z0-9-]++(?: dot [a-z0-9-]++)+)",
    re.ASCII,
)
_FOUR = re.compile(r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}")


def addresses(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first token, one past the last) of everything in a window that has the form of an address, each as long as can be."""
    if not tokens:
        return []
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    found = (m.span() for m in _MAIL.finditer(text, tokens[0][0], tokens[-1][1]))
    return [(starts[a], ends[b]) for a, b in found if a in starts and b in ends]


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidate segments (first token, one past the last) of a window."""
    words = [text[a:b] for a, b in tokens]
    usable = [w.isalnum() or w in _INNER for w in words]
    out = []
    for i, w in enumerate(words):
        if not usable[i] or not (w[0].isalnum() or w in "+("):
            continue
        digits, at, letters = 0, False, False
        for j in range(i, min(len(words), i + MOST_FIGURES)):
            if not usable[j]:
                break
            v = words[j]
            if v[0].isdigit():
                digits += len(v)
            elif v[0].isalpha():
                letters = True
            at = at or v == "@" or (v.lower() == "at" and words[j - 1] in ("[", "(", " "))
            if (letters or at) and j >= i + MOST_TOKENS or digits > MOST_DIGITS and not at:
                break
            if letters and not at and digits > 3 and " " in words[i : j + 1]:
                break
            # Only addresses have letters.
            if v[-1].isalnum() and (at or digits >= 4 and not letters):
                out.append((i, j + 1))
    known = set(out)
    return out + [x for x in addresses(text, tokens) if x not in known]


N_FEATURES = 29

#: Calendar days, year first or last, and times of day.
_DAY = re.compile(r"(?<![0-9])(?:(?:1[5-9]|20|21)[0-9]{2}([-. ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([-. ])(?:0?[1-9]|[12][0-9]|3[01])\2(?:1[5-9]|20|21)[0-9]{2})(?![0-9])")
_CLOCK = re.compile(r"(?<![0-9:])(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?![0-9])")
_YEAR = re.compile(r"(?:1[5-9]|20|21)[0-9]{2}")


def span_features(s: str, before: str, after: str, mail: bool) -> np.ndarray:
    """Features of a span as a whole (``mail``: a whole address by its form) and of the characters that touch it."""
    digits = _NOT_DIGIT.sub("", s)
    n, letters = len(digits), any(c.isalpha() for c in s)
    groups = re.findall(r"[0-9]+", s)
    four = bool(_FOUR.fullmatch(s)) and all(map(_small, groups))
    only = not letters and "@" not in s
    seps = {c for c in s if not c.isalnum()}
    return np.array(
        [
            1,
            mail,
            mail and "@" not in s,
            "@" in s or bool(_AT.search(s)),
            letters,
            four,
            four and "." in s,
            only and 12 <= n <= 19 and luhn(digits),
            only and 12 <= n <= 19,
            only and len(groups) > 2 and len({len(g) for g in groups[:-1]}) == 1 and n >= 12,
            s[0] == "+",
            s[0] == "(" and ")" in s,
            only and 9 <= n <= 15 and len(groups) > 2,
            only and 9 <= n <= 11,
            n < 9,
            n > 19,
            bool(seps & {" "}),
            bool(seps & {"-", "("}),
            bool(seps & {"."}),
            len(seps) > 3,
            before.isalnum() or after.isalnum(),
            after == "@" or before == "@" or (before in "-+." and before != ""),
            only and len(groups) == 1,
            only and n in (10, 11, 12) and len(groups) in (3, 4) and max(map(len, groups), default=0) <= 4,
            only and bool(_DAY.search(s)),
            only and bool(_CLOCK.search(s)),
            only and bool(groups) and any(_YEAR.fullmatch(g) for g in (groups[0], groups[-1])),
            only and ":" in s,
            s.count("(") != s.count(")"),
        ],
        dtype=np.float64,
    )


@dataclass
class Field:
    """Weights of spans by kind (0: none of them, one token long) and of neighbouring kinds."""

    spans: np.ndarray  # (kinds + 1, N_FEATURES)
    turns: np.ndarray  # (kinds + 1, kinds + 1)

    @classmethod
    def new(cls) -> Field:
        k = len(KINDS) + 1
        w = np.zeros((k, N_FEATURES))
        w[1:, 0] = -1.0
        return cls(w, np.zeros((k, k)))


def laid_out(text: str, a: int, b: int):
    """(tokens, segments, features of the segments) of one window."""
    tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
    found = segments(text, tokens)
    mails = set(addresses(text, tokens))
    rows = [span_features(text[tokens[i][0] : tokens[j - 1][1]], text[max(0, tokens[i][0] - 1) : tokens[i][0]], text[tokens[j - 1][1] : tokens[j - 1][1] + 1], (i, j) in mails) for i, j in found]
    return tokens, found, np.array(rows).reshape(-1, N_FEATURES)


def best_path(field: Field, n: int, found: list[tuple[int, int]], rows: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, end, kind number) of the best joint choice, leaving out tokens of no kind."""
    k = len(field.turns)
    scores = rows @ field.spans.T
    ending: dict[int, list[int]] = {}
    for s, (_, j) in enumerate(found):
        ending.setdefault(j, []).append(s)
    best = np.full((n + 1, k), -np.inf)
    best[0, 0] = 0
    back: list[list] = [[None] * k for _ in range(n + 1)]
    for j in range(1, n + 1):
        into = best[j - 1] + field.turns[:, 0]
        y = int(into.argmax())
        best[j, 0], back[j][0] = into[y], (j - 1, y)
        for s in ending.get(j, ()):
            i = found[s][0]
            into = best[i][:, None] + field.turns[:, 1:]
            y = into.argmax(0)
            gain = into.max(0) + scores[s, 1:]
            for q in np.flatnonzero(gain > best[j, 1:]):
                best[j, q + 1], back[j][q + 1] = gain[q], (i, int(y[q]))
    out, j, y = [], n, int(best[n].argmax())
    while j > 0:
        i, z = back[j][y]
        if y:
            out.append((i, j, y))
        j, y = i, z
    return out[::-1]


def likelihood(field: Field, n: int, found: list[tuple[int, int]], rows: np.ndarray, gold: dict[tuple[int, int], int]):
    """Log-likelihood of the labelled segmentation, and its gradients, by forward and backward sums."""
    k = len(field.turns)
    scores = rows @ field.spans.T
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for s, (i, j) in enumerate(found):
        by_end.setdefault(j, []).append(s)
        by_start.setdefault(i, []).append(s)
    fore, aft = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
    fore[0, 0] = 0
    with np.errstate(divide="ignore"):
        sums = lambda a, axis: np.logaddexp.reduce(a, axis)
        for j in range(1, n + 1):
            fore[j, 0] = sums(fore[j - 1] + field.turns[:, 0], 0)
            for s in by_end.get(j, ()):
                fore[j, 1:] = np.logaddexp(fore[j, 1:], sums(fore[found[s][0]][:, None] + field.turns[:, 1:], 0) + scores[s, 1:])
        aft[n] = 0
        for i in range(n - 1, -1, -1):
            aft[i] = field.turns[:, 0] + aft[i + 1, 0]
            for s in by_start.get(i, ()):
                aft[i] = np.logaddexp(aft[i], sums(field.turns[:, 1:] + (scores[s, 1:] + aft[found[s][1], 1:])[None, :], 1))
        total = sums(fore[n], 0)
        g_spans, g_turns = np.zeros_like(field.spans), np.zeros_like(field.turns)
        for s, (i, j) in enumerate(found):
            p = np.exp(fore[i][:, None] + field.turns[:, 1:] + (scores[s, 1:] + aft[j, 1:])[None, :] - total)
            g_turns[:, 1:] -= p
            g_spans[1:] -= p.sum(0)[:, None] * rows[s][None, :]
        for i in range(n):
            g_turns[:, 0] -= np.exp(fore[i] + field.turns[:, 0] + aft[i + 1, 0] - total)
    value, i, y = -total, 0, 0
    ends = {a: (b, q) for (a, b), q in gold.items()}
    number = {ij: s for s, ij in enumerate(found)}
    while i < n:
        j, q = ends.get(i, (i + 1, 0))
        value += field.turns[y, q]
        g_turns[y, q] += 1
        if q:
            value += scores[number[i, j], q]
            g_spans[q] += rows[number[i, j]]
        i, y = j, q
    return value, g_spans, g_turns


# --- training ---------------------------------------------------------------


def rewritten(text: str, span: Span, r: random.Random) -> tuple[str, Span] | None:
    """The same datum as people also write it, in its text."""
    kind, a, b = span
    s = text[a:b]
    if kind == "email":
        at, dot = r.choice([(" [at] ", "."), (" (at) ", "."), ("(at)", "."), (" @ ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot ")])
        local, domain = s.split("@", 1)
        s = local + at + domain.replace(".", dot)
    elif kind == "phone":
        d = _NOT_DIGIT.sub("", s)[-10:]
        if len(d) < 10:
            return None
        s = r.choice(["({}) {}-{}", "({}) {} {}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(d[:3], d[3:6], d[6:])
    elif kind == "card":
        d = _NOT_DIGIT.sub("", s)
        s = r.choice([".", " - ", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        s = s.replace(".", r.choice([":", "-"]))
    return text[:a] + s + text[b:], (kind, a, a + len(s))


def decoys(r: random.Random, n: int) -> list[str]:
    """Figures that are nobody's data: dates, times, prices, sizes and numbers of things."""
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    day = lambda: (r.choice(("19", "20")) + d(2), f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}")
    date = lambda: r.choice("-. ").join(day() if r.random() < 0.6 else day()[::-1])
    clock = lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}"
    shapes = (
        lambda: f"on {date()} {clock()} we",
        lambda: f"on {date()} {clock()}:{r.randint(0, 59):02} and {date()} {clock()} we",
        lambda: f"on {date()} we paid {d(4)}.{d(2)}",
        lambda: f"at {clock()} {date()} and {clock()}-{clock()} the",
        lambda: f"from {date()} to {date()} the",
        lambda: f"in {day()[0]}-{day()[0]} {d(2)} and {day()[0]} {d(4)} of",
        lambda: f"total {d(4)}.{d(2)} of {d(5)}.{d(2)} in {d(3)} 000 000",
        lambda: f"order {r.randint(1, 9)}{d(10)} and version {d(1)}.{d(2)}.{d(1)} and",
        lambda: f"pages {d(3)}-{d(3)} of {d(2)} {d(3)}, {d(4)} x {d(4)} at",
        lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)} and",
    )
    return [x for x in (r.choice(shapes)() for _ in range(n)) if not base_spans(x)]


def generated(kind: str, r: random.Random) -> str:
    """A made-up datum of a kind in a form of the fixed patterns, with words around it."""
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    if kind == "email":
        s = f"{name()}{r.choice(['', '.' + name(), '-' + d(2)])}@{name()}{r.choice(['', '.' + name()])}.{r.choice(['com', 'org', 'net', 'edu', 'de'])}"
    elif kind == "ip":
        s = ".".join(str(r.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        s = "4" + d(14)
        s += next(c for c in "0123456789" if luhn(s + c))
        s = r.choice(["", " ", "-"]).join(s[i : i + 4] for i in range(0, 16, 4))
    else:
        s = r.choice(["+1 ({}) {}-{}", "+1 {} {} {}", "+1-{}-{}-{}"]).format(f"{r.randint(2, 9)}{d(2)}", d(3), d(4))
    return f"{name()} {name()} {s} {name()} {name()}"


def train(samples: list[str], epochs: int = 6, rate: float = 0.1, seed: int = 3, least: int = 20) -> Field | None:
    """Weights from stretches of text; kinds that none of them holds are learned from generated forms.

    None without stretches: then no text holds a window, and nothing is there to be found.
    """
    if not samples:
        return None
    r, cases = random.Random(seed), []
    held = {k for text in samples for k, _, _ in base_spans(text)}
    samples = samples + [generated(k, r) for k in KINDS if k not in held for _ in range(least)]
    for text in samples:
        base = base_spans(text)
        spans = [s for i, s in enumerate(base) if not i or s[1] >= base[i - 1][2]]
        cases.append((text, spans))
        for s in spans:
            if (new := rewritten(text, s, r)) and len(spans) == 1:
                cases.append((new[0], [new[1]]))
    cases += [(x, []) for x in decoys(r, 160)]
    laid = []
    for text, spans in cases:
        tokens, found, rows = laid_out(text, 0, len(text))
        starts, ends, known = {t[0]: i for i, t in enumerate(tokens)}, {t[1]: i + 1 for i, t in enumerate(tokens)}, set(found)
        gold = {(starts[a], ends[b]): KINDS.index(k) + 1 for k, a, b in spans if a in starts and b in ends and (starts[a], ends[b]) in known}
        if len(gold) == len(spans) and found:
            laid.append((len(tokens), found, rows, gold))
    field = Field.new()
    sq_s, sq_t = np.full_like(field.spans, 1e-2), np.full_like(field.turns, 1e-2)
    for _ in range(epochs):
        r.shuffle(laid)
        for case in laid:
            _, gs, gt = likelihood(field, *case)
            gs -= 1e-3 * field.spans
            gt -= 1e-3 * field.turns
            sq_s += gs**2
            sq_t += gt**2
            field.spans += rate * gs / np.sqrt(sq_s)
            field.turns += rate * gt / np.sqrt(sq_t)
    return field


def stretches(text: str) -> Iterator[tuple[str, str]]:
    """(kind, stretch) around every base span, ("none", stretch) of windows without base spans and addresses, ("unknown", "") of others; of 300 characters or little more."""
    base, i = base_spans(text), 0
    for k, a, b in base:
        yield k, text[max(0, a - 100) : min(b, a + 300) + 100]
    for a, b in windows(text):
        while i < len(base) and base[i][2] <= a:
            i += 1
        # Addresses in other forms have no label, so their windows would teach that they are none.
        if i == len(base) or base[i][1] >= b:
            yield ("none", text[a : min(b, a + 300)]) if not _MAIL.search(text, a, b) else ("unknown", "")


def training_windows(docs: DataFrame, most_windows: int = 400, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """A bounded sample of stretches over all documents: by hash, equally many around base spans of each kind and without any."""
    kinds = (*KINDS, "none")
    most = most_windows // len(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[str, int]] = {k: {} for k in (*kinds, "unknown")}
        for batch in batches:
            for t in batch.column("body").to_pylist():
                for k, x in stretches(t):
                    best[k].setdefault(x, zlib.crc32(x.encode("utf-8", "replace")))
                for k, of in best.items():
                    if len(of) > 8 * most:
                        best[k] = dict(_lowest(of, most))
        rows = [(k, x, h) for k, of in best.items() for x, h in _lowest(of, most)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "stretch", "h"])

    marked = docs.select(F.col(text_col).alias("body")).where(F.col("body").rlike(r"(?i)[0-9@]|[\[(] ?at ?[\])]| at [a-z0-9-]+ dot "))
    found = materialize(marked.mapInArrow(run, "kind string, stretch string, h bigint"), "personal-data-windows")
    chosen = [found.where(F.col("kind") == k).select("h", "stretch").distinct().orderBy("h", "stretch").limit(most).collect() for k in kinds]
    if not any(chosen) and not found.isEmpty():
        return decoys(random.Random(3), most)
    return [x["stretch"] for rows in chosen for x in rows]


def _lowest(of: dict[str, int], most: int) -> list[tuple[str, int]]:
    return heapq.nsmallest(most, of.items(), key=lambda x: (x[1], x[0].encode("utf-8", "replace")))


# --- application ------------------------------------------------------------


def all_spans(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and those that the field adds)."""
    base = base_spans(text)
    if field is None:
        return base, base
    added: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    for a, b in windows(text):
        tokens, found, rows = laid_out(text, a, b)
        if found:
            for i, j, y in best_path(field, len(tokens), found, rows):
                s, e = tokens[i][0], tokens[j - 1][1]
                if not any(x < e and s < z for x, z in taken):
                    added.append((KINDS[y - 1], s, e))
    return base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]))) if added else base


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])


def find_personal_data(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, stop).

    Null and empty texts have none.  Repeated rows give equal results; an
    empty table gives an empty one.
    """
    wanted = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("doc_id", wanted.schema["doc_id"].dataType), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("spans", T.ArrayType(_SPAN))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", field) for t in batch.column("text").to_pylist()]
            column = lambda which: pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in x[which]] for x in found], arrow)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column(0), column(1)], schema.names)

    return wanted.mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind; of overlapping spans the union, named by the first."""
    out, done = [], 0
    for k, a, b in spans:
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], f"[{k.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redact_documents(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with its personal data replaced in ``text_col``; all other columns and null texts as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = [t if t is None else redacted(t, all_spans(t, field)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
