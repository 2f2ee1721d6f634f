"""Sort keys and normalised strings as native column expressions.

A chain is a list of (pattern, replacement) steps, so that the same list can be
written out for another SQL engine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Steps = list[tuple[str, str]]

SPACES: Steps = [(r"^\s+", ""), (r"\s{2,}", " ")]
THOUSANDS_AND_RANGES: Steps = [(r"([0-9]{1,3}),([0-9])", r"\1\2"), (r"([0-9])\s*-+\s*[0-9]+", r"\1")]
DECIMALS: Steps = [(r"([^ 0-9])\.", r"\1 ."), (r"\.([^ 0-9])", r"\1")]
SEPARATE: Steps = [(r"([^ .0-9])([0-9])", r"\1 \2"), (r"([0-9])([^ .0-9])", r"\1 \2")]
LABELS: Steps = [(r"(^|\s+)[A-Za-z]+[. ]*([0-9])", r"\1\2")]
LC_BEFORE_UPPER: Steps = [*SPACES, (r"([a-z])\.\s*", r"\1 ")]
LC_AFTER_UPPER: Steps = [*THOUSANDS_AND_RANGES, *DECIMALS, (r"^([A-Z]+)([0-9])", r"\1 \2"), (r"([0-9])([^ .0-9])", r"\1 \2")]
#: Between single digits and others, overlapping hits of the two replacements are left as one pass leaves them.
SUDOC_SUFFIX: Steps = [(r"\.([0-9])", r" \1"), (r"(^|[^0-9])(9[0-9][0-9])($|[^0-9])", r"\1.\2\3"), (r"(^|[^0-9])(2[0-9][0-9][0-9])($|[^0-9])", r"\1.\2\3")]
SUDOC_LETTERS: Steps = [(r"([^A-Z .])([A-Z]+)", r"\1.\2"), (r"([^.])(\.)", r"\1 \2"), (r"[/:-]", " "), *SPACES]
SEARCH: Steps = [(r"[\s./,?-]", "")]


def apply_steps(c: Column, steps: Steps) -> Column:
    """Replacements one after another."""
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new.replace("\\", "$"))
    return c


def padded_numbers(c: Column, decimals: bool = True) -> Column:
    """Numbers among the words padded to ten digits; longer ones stay whole and fraction digits stay text."""
    pattern = r"^[0-9]*\.?[0-9]+$" if decimals else r"^[0-9]+$"

    def one(w: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(w, r"^([0-9]*)", 1), "^0+", "")
        fraction = F.regexp_replace(F.regexp_extract(w, r"(\.[0-9]+)$", 1), r"^\.0+$", "")
        return F.when(w.rlike(pattern), F.concat(F.lpad(whole, F.greatest(F.length(whole), F.lit(10)), "0"), fraction)).otherwise(w)

    return F.array_join(F.transform(F.split(c, " "), one), " ")


def _marked(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("!"))


def lc_key(c: Column) -> Column:
    """N1"""
    return _marked(padded_numbers(apply_steps(F.upper(apply_steps(c, LC_BEFORE_UPPER)), LC_AFTER_UPPER)))


def dewey_key(c: Column) -> Column:
    """N2"""
    return _marked(padded_numbers(apply_steps(F.upper(c), [*SPACES, *SEPARATE])))


def let(c: Column, then) -> Column:
    """``then(c)`` with ``c`` computed once, however often it is used."""
    return F.get(F.transform(F.array(c), then), 0)


def sudoc_key(c: Column) -> Column:
    """Stem and suffix around exactly one colon; without it all is stem."""

    def key(parts: Column) -> Column:
        two = F.size(parts) == 2
        stem = F.replace(F.when(two, F.get(parts, 0)).otherwise(F.array_join(parts, ":")), F.lit("."), F.lit(" "))
        full = let(stem, lambda s: F.when(s.contains("/"), s).otherwise(F.concat(s, F.lit("/0"))))
        full = let(full, lambda s: F.when(s.contains("-"), s).otherwise(F.concat(s, F.lit("-0"))))
        suffix = apply_steps(F.when(two, F.get(parts, 1)).otherwise(F.lit("")), SUDOC_SUFFIX)
        return apply_steps(F.concat(full, F.lit(":"), suffix), SEPARATE)

    whole = let(F.split(apply_steps(F.upper(c), SPACES), ":"), key)
    return F.when(c.isNotNull(), _marked(apply_steps(padded_numbers(whole, decimals=False), SUDOC_LETTERS)))


def other_key(c: Column) -> Column:
    """N4"""
    return _marked(F.upper(padded_numbers(apply_steps(c, [*SPACES, *THOUSANDS_AND_RANGES, *SEPARATE]))))


def volume_key(c: Column) -> Column:
    """N4, with labels before numbers removed."""
    return _marked(F.upper(padded_numbers(apply_steps(c, [*SPACES, *LABELS, *THOUSANDS_AND_RANGES, *DECIMALS, *SEPARATE]))))


def search_key(c: Column) -> Column:
    """N6"""
    return apply_steps(F.upper(c), SEARCH)


def sort_key(c: Column, kind: Column) -> Column:
    """Key of the declared type; that of other types where a key is missing."""
    by_kind = F.when(kind == "lc", lc_key(c)).when(kind == "dewey", dewey_key(c)).when(kind == "sudoc", sudoc_key(c))
    return F.coalesce(by_kind, other_key(c))


#: Letters that no decomposition parts from their marks, and their plain forms, one for one (fixed values).
_STROKES, _STRUCK = "øłđħŧıƀɨɍɏ", "oldhtibiry"
#: Letters that stand for several (fixed values).
SEVERAL = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ð", "d"), ("þ", "th"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ĳ", "ij"))


@lru_cache(1)
def _plain_forms() -> tuple[str, str]:
    """Small letters and digits of all kinds, and the one ASCII letter or digit that their compatibility decomposition leaves without marks."""
    found = []
    for c in map(chr, range(0xA0, 0xFFF0)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if c == c.lower() and len(bare) == 1 and bare.isascii() and bare.isalnum():
            found.append((c, bare))
    return "".join(c for c, _ in found) + _STROKES, "".join(x for _, x in found) + _STRUCK


def fold(c: Column) -> Column:
    """Lower case without marks; marks of their own go too, letters of other scripts stay.

    A text of ASCII alone is only lower-cased.
    """

    def folded(low: Column) -> Column:
        out = F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), *_plain_forms())
        for a, b in SEVERAL:
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(F.octet_length(low) == F.length(low), low).otherwise(out)

    return let(F.lower(c), folded)


def facet_key(c: Column, nonfiling: Column | int = 0) -> Column:
    """Folded words of any script joined by hyphens, ``~`` when nothing is left.

    The first ``nonfiling`` characters go if the last of them is no letter or digit.
    """
    n = F.lit(nonfiling) if isinstance(nonfiling, int) else nonfiling
    low = F.lower(c)
    cut = (n > 0) & (F.length(low) > n) & ~F.substring(low, n, 1).rlike(r"[\p{L}\p{N}]")
    key = fold(F.when(cut, F.substring(low, n + 1, F.length(low))).otherwise(low))
    key = F.regexp_replace(F.regexp_replace(key, r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.when(c.isNotNull(), F.lit("~")))


def keyed_facet(c: Column, nonfiling: Column | int = 0) -> Column:
    """Key and heading."""
    return F.concat_ws("!", facet_key(c, nonfiling), c)


#: Spaces before closing marks, doubled marks, doubled spaces, blanks and marks at both ends; in linear time on long runs of these.
_TIDY: Steps = [(r"(?<!\s)\s++([,;:.!?])", r"\1"), (r"([,;:])[,;:]+", r"\1"), (r"\s+", " "), (r"^[ ,;:/]+", ""), (r"(?<![ ,;:/])[ ,;:/]++$", "")]


def tidy(c: Column) -> Column:
    """N9"""
    return apply_steps(c, _TIDY)


#: Words whose last period belongs to them (fixed values); callers with more of them pass their own.
ABBREVIATIONS = ("ca", "cf", "ch", "Co", "comp", "Corp", "Dept", "Dr", "ed", "eds", "enl", "etc", "fl", "Inc", "introd", "Jr", "Ltd", "Mr", "Mrs", "No", "no", "op", "pbk", "pt", "pts", "repr", "rev", "ser", "Sr", "St", "suppl", "trans", "v", "vol", "vols")


def strip_ends(c: Column, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    """A term without blanks and marks ``. / ; : ,`` around it; periods of initials, abbreviations and ellipses stay."""
    own = rf"(?<!\b[A-Z])(?<!\b(?:{'|'.join(abbreviations)}))\.(?<!\.\.\.)" if abbreviations else r"(?<!\b[A-Z])\.(?<!\.\.\.)"
    left = F.regexp_replace(c, r"^(?:[/;:,\s]|\.(?![\w.]))+", "")
    return F.regexp_replace(left, rf"(?<![/;:,\s])(?:[/;:,\s]|{own})++$", "")


def truncated(c: Column, least: int, most: int) -> Column:
    """Cut before the last punctuation (else space) between ``least`` and ``most`` characters; at ``least`` without either."""
    part = F.substring(c, least, most - least + 1)
    by_mark = F.regexp_extract(part, r"(?s)^(.*)[^\w\s]\s", 1)
    by_space = F.regexp_extract(part, r"(?s)^(.*\S|)\s", 1)
    head = F.substring(c, 1, least - 1)
    return (
        F.when(F.length(c) <= most, c)
        .when(part.rlike(r"[^\w\s]\s"), F.concat(head, by_mark))
        .when(part.rlike(r"\s"), F.concat(head, by_space))
        .otherwise(F.substring(c, 1, least))
    )


def label_code(c: Column, rules: list[tuple[str, str, str | None]], default: str | None = None) -> Column:
    """Code of the first (pattern, code, excluding pattern) that a label meets."""
    out = None
    for pattern, code, without in rules:
        hit = c.rlike(pattern) & (~c.rlike(without) if without else F.lit(True))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)
