"""Conditions on documents: the query API's operators, null-safe and over arrays.

A condition is (field, operator, negate, value).  A field names its columns and
kind; strings are exact values, texts are folded words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fold

KINDS = ("string", "text", "int", "float", "bool", "date")
OPERATORS = ("exact", "in", "gt", "gte", "lt", "lte", "range", "contains", "startswith", "endswith", "matches", "isnull", "keywords")
#: Texts that stand for false (fixed values).
FALSE_WORDS = ("false", "f", "0", "null", "n", "no", "not", "")


@dataclass(frozen=True)
class Field:
    """A public field: its column, and where order and keyword search look instead."""

    column: str
    kind: str = "string"
    multi: bool = False
    filterable: bool = True
    order_column: str | None = None
    keyword_column: str | None = None
    prepare: Callable[[Column], Column] | None = None  # query values go through the same expression as the column did


Condition = tuple[str, str, bool, Any]


def words(c: Column) -> Column:
    """Folded words of a text."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def holds_phrase(tokens: Column, phrase: Column) -> Column:
    """The words of ``phrase`` stand in ``tokens`` one after another."""
    around = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return around(tokens).contains(around(phrase)) & (F.size(phrase) > 0)


def keyword_match(tokens: Column, query: str) -> Column:
    """Boolean word query: words and quoted phrases, OR unless joined by AND, NOT before what must be absent."""
    parts = re.findall(r'"([^"]*)"|(\S+)', query)
    groups: list[list[Column]] = []
    none: list[Column] = []
    join_next = negate = False
    for phrase, word in parts:
        if word in ("AND", "OR", "NOT"):
            join_next, negate = (True, negate) if word == "AND" else (join_next, True) if word == "NOT" else (False, negate)
            continue
        hit = holds_phrase(tokens, words(F.lit(phrase or word)))
        if negate:
            none.append(~hit)
        elif join_next and groups:
            groups[-1].append(hit)
        else:
            groups.append([hit])
        join_next = negate = False
    some = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, g) for g in groups)) if groups else F.lit(True)
    return reduce(lambda a, b: a & b, none, some)


def cast_value(value: Any, kind: str) -> Any:
    """A query value in the field's type, or ValueError."""
    try:
        if kind == "int":
            return int(float(value))
        if kind == "float":
            return float(value)
        if kind == "bool":
            return value if isinstance(value, bool) else str(value).lower() not in FALSE_WORDS
        return value if kind == "date" else str(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"Could not convert value {value!r}") from e


def _test(f: Field, op: str, value: Any) -> Callable[[Column], Column]:
    ready = lambda v: f.prepare(F.lit(v)) if f.prepare else F.lit(v)
    if op == "in":
        return lambda c: reduce(lambda a, b: a | b, [c == ready(cast_value(v, f.kind)) for v in value], F.lit(False))
    if op == "range":
        low, high = (ready(cast_value(v, f.kind)) for v in list(value)[:2])
        return lambda c: c.between(low, high)
    if op in ("contains", "startswith", "endswith"):
        return lambda c: getattr(c.cast("string"), op)(ready(str(value)))
    if op == "matches":
        return lambda c: c.rlike(str(value))
    v = ready(cast_value(value, f.kind))
    return {"exact": lambda c: c == v, "gt": lambda c: c > v, "gte": lambda c: c >= v, "lt": lambda c: c < v, "lte": lambda c: c <= v}[op]


def predicate(f: Field, op: str, value: Any) -> Column:
    """The test of one condition, never null."""
    c = F.col(f.column)
    if op == "isnull":
        missing = c.isNull() | (F.size(c) == 0) if f.multi else c.isNull()
        missing = F.coalesce(missing, F.lit(True))
        return missing if (value if isinstance(value, bool) else str(value).lower() not in ("false", "f", "0", "null")) else ~missing
    if op == "keywords":
        source = F.col(f.keyword_column or f.column)
        out = keyword_match(words(F.array_join(source, " ") if f.multi and not f.keyword_column else source), str(value))
    elif f.kind == "text":
        tokens = (lambda x: F.exists(words(x), _test(Field(f.column), op, fold_value(value)))) if op not in ("exact", "in") else None
        if tokens is None:
            values = [value] if op == "exact" else list(value)
            tokens = lambda x: reduce(lambda a, b: a | b, [holds_phrase(words(x), words(F.lit(str(v)))) for v in values], F.lit(False))
        out = F.exists(c, tokens) if f.multi else tokens(c)
    elif f.kind in ("int", "float") and op in ("endswith", "matches", "contains"):
        out = F.lit(False)
    else:
        test = _test(f, op, value)
        out = F.exists(c, test) if f.multi else test(c)
    return F.coalesce(out, F.lit(False))


def fold_value(value: Any) -> Any:
    return value.lower() if isinstance(value, str) else value


def checked(conditions: Sequence[Condition], fields: Mapping[str, Field]) -> None:
    """Arguments that no plan should be made from raise ValueError."""
    for name, op, _, value in conditions:
        if name not in fields or not fields[name].filterable:
            raise ValueError(f"{name!r} is not a field to filter by")
        if op not in OPERATORS:
            raise ValueError(f"{op!r} is not an operator")
        if op == "startswith" and fields[name].kind in ("int", "float"):
            raise ValueError(f"{op!r} does not work on numbers")
        if op in ("in", "range") and (isinstance(value, str) or len(value) < (2 if op == "range" else 1)):
            raise ValueError(f"{op!r} takes a list of values")


def apply_filters(df: DataFrame, conditions: Sequence[Condition], fields: Mapping[str, Field]) -> DataFrame:
    """All conditions ANDed; a negated one keeps what does not match, missing values too."""
    checked(conditions, fields)
    for name, op, negate, value in conditions:
        test = predicate(fields[name], op, value)
        df = df.where(~test if negate else test)
    return df


def exclude(df: DataFrame, conditions: Sequence[Condition], fields: Mapping[str, Field]) -> DataFrame:
    """Rows that meet none of the conditions."""
    return apply_filters(df, [(n, op, not neg, v) for n, op, neg, v in conditions], fields)
