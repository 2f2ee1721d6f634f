"""Counts, facets and merged results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def facet(df: DataFrame, column: str, least: int = 1, by: str = "count", multi: bool = False) -> DataFrame:
    """A1: values and counts, at least ``least``, in order of count (most first) or of value."""
    values = df.select(F.explode(column).alias("value")) if multi else df.select(F.col(column).alias("value"))
    counts = values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "value") if by == "count" else counts.orderBy("value")


def total(df: DataFrame) -> DataFrame:
    """A2"""
    return df.agg(F.count("*").alias("total"))


def locations_of(docs: DataFrame, ids: DataFrame, key: str = "item_id") -> DataFrame:
    """A3: locations that a set of ids touches."""
    return docs.join(ids.select(key), key, "left_semi").select("location_code").distinct()


def union_sets(parts: DataFrame, key: str, column: str) -> DataFrame:
    """A4: union of the sets that the parts of a run report."""
    return parts.select(key, F.explode(column).alias("_v")).groupBy(key).agg(F.array_sort(F.collect_set("_v")).alias(column))


def merge_results(parts: DataFrame, run: str, part: str, lists: str, scalars: str) -> DataFrame:
    """A5: per run and path, lists of all parts one after another and the last part's scalar.

    ``lists`` is a map of path to array, ``scalars`` one of path to value.
    """
    listed = (
        parts.select(run, part, F.explode(lists).alias("path", "values"))
        .groupBy(run, "path")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(part, "values"))), lambda x: x["values"])).alias("merged"))
    )
    last = parts.select(run, part, F.explode(scalars).alias("path", "value")).groupBy(run, "path").agg(F.max_by("value", part).alias("last_value"))
    return listed.join(last, [run, "path"], "full")


def merge_nested(parts: DataFrame, run: str, part: str, column: str) -> DataFrame:
    """A5 for maps of any depth: (run, column), the maps of all parts merged level by level.

    Lists of equal paths stand one after another by part, of single values the
    last part's stays.  A run without any value is left out.
    """

    def merged(df: DataFrame, keys: list[str], kind: T.DataType) -> DataFrame:
        if isinstance(kind, T.MapType):
            name = f"_key{len(keys)}"
            inner = merged(df.select(*keys, part, F.explode(column).alias(name, column)), [*keys, name], kind.valueType)
            return inner.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, column))).alias(column))
        if isinstance(kind, T.ArrayType):
            lists = F.transform(F.array_sort(F.collect_list(F.struct(part, column))), lambda x: x[column])
            return df.groupBy(*keys).agg(F.flatten(lists).alias(column))
        return df.groupBy(*keys).agg(F.max_by(column, part).alias(column))

    return merged(parts.select(run, part, column), [run], parts.schema[column].dataType)


def run_totals(parts: DataFrame, operation: str, record_set: str, amount: str) -> DataFrame:
    """Counts and sums by operation and record set, by operation, and of all."""
    return parts.rollup(operation, record_set).agg(F.sum(amount).alias("amount"), F.count("*").alias("parts"))


def reverse_mapping(df: DataFrame, key: str, value: str, multi: bool = True) -> DataFrame:
    """Value to its keys, or to the greatest of them."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("keys") if multi else F.max(key).alias("key"))


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values in the order in which they are first seen."""
    return df.groupBy(value).agg(F.min(position).alias("first_seen")).orderBy("first_seen", value)
