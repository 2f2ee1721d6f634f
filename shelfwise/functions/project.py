"""Derived columns of documents."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(df: DataFrame, *fields: str) -> DataFrame:
    """J1"""
    return df.select(*fields)


def camel(name: str) -> str:
    lead = re.match("_*", name)[0]
    first, *rest = name[len(lead) :].split("_")
    return lead + first + "".join(w[:1].upper() + w[1:] for w in rest)


def camelize(df: DataFrame) -> DataFrame:
    """Snake names to camel; a leading underscore stays."""
    return df.toDF(*map(camel, df.columns))


def present(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns cast to what they are declared as; ``json:<schema>`` parses."""
    as_type = lambda n, t: F.from_json(n, t[5:]) if t.startswith("json:") else F.col(n).cast(t)
    return df.select(*[as_type(n, types[n]).alias(n) if n in types else F.col(n) for n in df.columns])


def cat_fields(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), out: str = "text") -> DataFrame:
    """All included (or all but excluded) fields joined by blanks; arrays flattened, nulls skipped."""
    names = list(include) or [c for c in df.columns if c not in exclude]
    kinds = dict(df.dtypes)
    return df.withColumn(out, F.concat_ws(" ", *[F.array_join(n, " ") if kinds[n].startswith("array") else F.col(n).cast("string") for n in names]))


def check_digit(number: Column) -> Column:
    """Weighted digit sum (2 for the last digit, 3 for the one before, ...; seven digits) modulo 11; ``x`` for 10."""
    total = sum((F.floor(number / 10**i) % 10 * (i + 2) for i in range(7)), F.lit(0))
    rest = (total % 11).cast("int")
    return F.when(rest == 10, "x").otherwise(rest.cast("string"))


def record_id(record_type: Column, number: Column, check: bool = False) -> Column:
    """J5"""
    return F.concat(record_type, number.cast("string"), *([check_digit(number)] if check else []))


def suppressed(item_code: Column, bib_suppressed: Column) -> Column:
    """The item's code is not ``-``, or its first bib is suppressed."""
    return F.coalesce(item_code != "-", F.lit(True)) | F.coalesce(bib_suppressed, F.lit(False))


def item_status(code: Column, due: Column, label: Column) -> Column:
    """J7"""
    return F.when((code == "-") & due.isNotNull(), "CHECKED OUT").otherwise(label)


def strip_uris(c: Column) -> Column:
    """Addresses after a blank go."""
    return F.regexp_replace(c, r"\s+https?:\S*", "")


def clean_url(c: Column) -> Column:
    """Up to the first quotation mark."""
    return F.regexp_extract(c, '^([^"]*)', 1)


def date_added(bibs: DataFrame, bib_locations: DataFrame, key: str, created: str, catalogued: str) -> DataFrame:
    """The created date if all locations end in ``www`` (so with none at all), else the catalogued one."""
    online = bib_locations.groupBy(key).agg(F.bool_and(F.col("location_code").endswith("www")).alias("_online"))
    return bibs.join(online.hint("shuffle_hash"), key, "left").withColumn("date_added", F.when(F.coalesce("_online", F.lit(True)), F.col(created)).otherwise(F.col(catalogued))).drop("_online")


def record_boost(year: Column, level: Column, this_year: int) -> Column:
    """Recency up to ``this_year`` + 5 (500 in 2020, at least 1; 460 without a usable year) plus 500 for full records."""
    recency = F.when(year <= this_year + 5, F.greatest(F.lit(500) - (F.lit(2020) - year), F.lit(1))).otherwise(F.lit(460))
    return (F.coalesce(recency, F.lit(460)) + F.when(level.isin("-", "d"), 500).otherwise(0)).cast("int")


def alternate_titles(x_fields: Column, p_fields: Column, title: Column) -> Column:
    """Distinct ``x`` fields and the first ``p``, without the main title, sorted."""
    first = F.filter(F.slice(F.coalesce(p_fields, F.array().cast("array<string>")), 1, 1), lambda v: v.isNotNull())
    return F.array_sort(F.array_except(F.array_distinct(F.concat(F.coalesce(x_fields, F.array().cast("array<string>")), first)), F.array(title)))


def display_content(c: Column, codes: str = "", separator: str = " ", keep: bool = True) -> Column:
    """Marked content for display: only the subfields listed (or all but them, or all), marks replaced."""
    if codes:
        drop = f"[^|{re.escape(codes)}]" if keep else f"[{re.escape(codes)}]"
        c = F.regexp_replace(c, rf"\|{drop}[^|]*", "")
    return F.regexp_replace(F.regexp_replace(c, r"^\|.", ""), r"\|.", separator)


def composite_key(columns: Sequence[str], separator: str = "-") -> Column:
    """Parts joined; a missing part is empty."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
