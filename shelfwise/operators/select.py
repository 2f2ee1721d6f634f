"""Selecting the records that a run works on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .shelflist import ranked


def select_full(records: DataFrame, body: DataFrame, key: str) -> DataFrame:
    """Headers joined to bodies, with the ``position`` (from 0) by record number."""
    return ranked(records.join(body, key), [F.col(key)], out="position")


def select_since(df: DataFrame, stamp: str, mark: datetime) -> DataFrame:
    """R2: updated at or after the high-water mark."""
    return df.where(F.col(stamp) >= F.lit(mark))


def high_water_mark(runs: DataFrame, run_type: str, type_col: str = "type", status_col: str = "status", stamp: str = "timestamp", done: Sequence[str] = ("success", "done_with_errors")) -> datetime:
    """Stamp of the newest finished run of a type; an error if there is none."""
    found = newest_runs(runs, type_col, status_col, stamp, done).where(F.col(type_col) == run_type).first()
    if found is None:
        raise LookupError(f"no finished run of type {run_type!r}")
    return found[stamp]


def newest_runs(runs: DataFrame, type_col: str, status_col: str, stamp: str, done: Sequence[str]) -> DataFrame:
    """R3 for every type at once."""
    return runs.where(F.col(status_col).isin(*done)).groupBy(type_col).agg(F.max(stamp).alias(stamp))


def day_bounds(first: date, last: date, zone: str, end_time: str = "23:59:59.000099") -> tuple[Column, Column]:
    """UTC stamps from local midnight of one day to ``end_time`` of another."""
    return F.to_utc_timestamp(F.lit(f"{first} 00:00:00").cast("timestamp"), zone), F.to_utc_timestamp(F.lit(f"{last} {end_time}").cast("timestamp"), zone)


def select_updated_between(df: DataFrame, stamp: str, first: date, last: date, zone: str = "UTC", end_time: str = "23:59:59.000099") -> DataFrame:
    """R4"""
    low, high = day_bounds(first, last, zone, end_time)
    return df.where(F.col(stamp).between(low, high))


def select_deleted_between(df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    """The same on the date of deletion."""
    return df.where(F.col(column).between(F.lit(first), F.lit(last)))


def select_with_related(parent: DataFrame, child: DataFrame, key: str, parent_is: Column, child_is: Column) -> DataFrame:
    """Parents that meet a condition themselves or through any attached child, each once."""
    through = child.where(child_is).select(F.col(key).alias("_key")).distinct().withColumn("_through", F.lit(True))
    return parent.join(through, F.col(key) == F.col("_key"), "left").where(F.coalesce(parent_is, F.lit(False)) | F.col("_through").isNotNull()).drop("_key", "_through")


def select_number_range(df: DataFrame, low: str, high: str, type_col: str = "record_type", number_col: str = "record_num") -> DataFrame:
    """Records of one type from, say, ``b100`` to ``b200``."""
    if low[:1] != high[:1]:
        raise ValueError("both ends must be of one record type")
    return df.where((F.col(type_col) == low[0]) & F.col(number_col).between(int(low[1:]), int(high[1:])))


def select_by_location(bibs: DataFrame, bib_locations: DataFrame, items: DataFrame, locations: Sequence[str], which: str = "both", key: str = "bib_num") -> DataFrame:
    """Bibs by their own locations, by their items' or by either."""
    at = lambda df: df.where(F.col("location_code").isin(*locations)).select(key)
    keys = {"item": [items], "bib": [bib_locations], "both": [items, bib_locations]}[which]
    return bibs.join(reduce(DataFrame.unionByName, map(at, keys)), key, "left_semi")


def deletions(df: DataFrame, record_type: str, type_col: str = "record_type", column: str = "deleted_date") -> DataFrame:
    """R9"""
    return df.where(F.col(column).isNotNull() & (F.col(type_col) == record_type))


def dnf_filter(df: DataFrame, anyof: Sequence[Sequence[Column]]) -> DataFrame:
    """OR over groups of conditions that are ANDed; R11 chains further filters."""
    return df.where(reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, group) for group in anyof)))


def select_with_filters(df: DataFrame, filters: Sequence[Column]) -> DataFrame:
    """R11"""
    return reduce(DataFrame.where, filters, df)


def derive_attached(selected: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of the other side of a link that belong to a selection, each once."""
    return other.join(selected.select(key), key, "left_semi")


def load_codes(docs: DataFrame, new: Mapping[str, DataFrame], type_col: str = "type") -> DataFrame:
    """Code documents of several types; each type given replaces its old rows, an empty one leaves them."""
    for name, rows in new.items():
        if not rows.isEmpty():
            docs = docs.where(~F.coalesce(F.col(type_col) == name, F.lit(False))).unionByName(rows)
    return docs


def key_ranges(df: DataFrame, key: str, size: int) -> DataFrame:
    """First key, last key and count of consecutive stretches of ``size`` keys; no task holds more than a range of the sort."""
    placed = ranked(df.select(key), [F.col(key)], out="_nth")
    return placed.groupBy(F.floor(F.col("_nth") / size).alias("range_no")).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n"))


def harvest(roots: Mapping[str, DataFrame], chains: Sequence[Sequence[tuple[str, str, str, str]]], tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Rows of all tables that filtered root rows lead to.

    A chain is a list of steps (table, column, other table, other column);
    each step keeps the rows of the other table that the rows so far refer to.
    """
    found: dict[str, list[DataFrame]] = {name: [df] for name, df in roots.items()}
    for chain in chains:
        at = roots[chain[0][0]]
        for _, column, other, other_column in chain:
            refs = at.select(F.col(column).alias(other_column)).distinct()
            at = tables[other].join(refs, other_column, "left_semi")
            found.setdefault(other, []).append(at)
    return {name: reduce(DataFrame.unionByName, parts).dropDuplicates(list(keys[name])) for name, parts in found.items()}


def closed_sample(roots: Mapping[str, DataFrame], relations: Sequence[tuple[str, str, str, str]], tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Rows of all tables that root rows lead to by relations (table, column, other table, other column), however often and in what circle these are followed.

    Semi-naive: a round follows the relations from the keys that the last one
    found, drops those known already, and stores the rest; it ends when no
    table has new keys.  Only keys are kept on the way, rows come at the end.
    """
    new = {name: stored(df.select(*keys[name]).distinct(), "sample-new") for name, df in roots.items()}
    known: dict[str, DataFrame] = {}
    while new:
        known = {**known, **{name: df if name not in known else known[name].unionByName(df) for name, df in new.items()}}
        found: dict[str, list[DataFrame]] = {}
        for table, column, other, other_column in relations:
            if table in new:
                refs = tables[table].join(new[table], list(keys[table]), "left_semi").select(F.col(column).alias(other_column)).distinct()
                found.setdefault(other, []).append(tables[other].join(refs, other_column, "left_semi").select(*keys[other]))
        new = {}
        for name, parts in found.items():
            rows = reduce(DataFrame.unionByName, parts).distinct()
            fresh = stored(rows.join(known[name], list(keys[name]), "left_anti") if name in known else rows, "sample-new")
            if not fresh.isEmpty():
                new[name] = fresh
    return {name: tables[name].join(df, list(keys[name]), "left_semi") for name, df in known.items()}
