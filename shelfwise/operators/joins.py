"""Joins of records and documents.  Codes without a match are normal, so look-ups are left joins.

Code tables are joined without a hint: Spark broadcasts them while they are
under its own size limit and shuffles beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_parent_bib(items: DataFrame, links: DataFrame, bibs: DataFrame, columns: Sequence[str], key: str = "item_id", link_id: str = "link_id") -> DataFrame:
    """L1: each item with columns of its first bib (by link id, then bib); null when unlinked."""
    first = links.groupBy(key).agg(F.min_by("bib_num", F.struct(link_id, "bib_num")).alias("parent_bib"))
    parents = bibs.select(F.col("bib_num").alias("parent_bib"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return items.join(first, key, "left").join(parents, "parent_bib", "left")


def with_labels(df: DataFrame, codes: DataFrame, column: str, code: str, label: str, out: str) -> DataFrame:
    """L2: the label of a code; null where there is none."""
    return df.join(codes.select(F.col(code).alias(column), F.col(label).alias(out)), column, "left")


def names_in_language(codes: DataFrame, names: DataFrame, language: str, code: str = "code") -> DataFrame:
    """L3: codes with their name in one language; null where it is not named in it."""
    return codes.join(names.where(F.col("language") == language).select(code, "name"), code, "left")


def with_checkout(items: DataFrame, checkouts: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """L4: items with the dates of their checkout, if any."""
    return items.join(checkouts.select(key, *columns), key, "left")


def with_items(bibs: DataFrame, items: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Bibs with an ordered array of their items; empty where there are none."""
    listed = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *columns))).alias("items"))
    listed = listed.withColumn("items", F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in columns])))
    out = bibs.join(listed, key, "left")
    return out.withColumn("items", F.coalesce("items", F.expr("filter(items, x -> false)"), F.array().cast(listed.schema["items"].dataType)))


def with_holdings(resources: DataFrame, holdings: DataFrame, bibs: DataFrame, resource: str, bib: str, position: str, title: str) -> DataFrame:
    """Titles of each resource's holdings in order of position; holdings without a bib are left out."""
    titled = holdings.join(bibs.select(bib, title), bib)
    listed = titled.groupBy(resource).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, title))), lambda x: x[title]).alias("holdings"))
    return resources.join(listed, resource)


def match_by_url_title(left: DataFrame, right: DataFrame, key: str, match_key: str, url: str = "url", title: str = "title") -> DataFrame:
    """For each row on the left the first row on the right with the same URL and, apart from case, title."""
    a = left.select(key, F.col(url).alias("_url"), F.lower(title).alias("_title"))
    b = right.select(F.col(match_key), F.col(url).alias("_url"), F.lower(title).alias("_title"))
    # First per (url, title) before the join: a URL that many rows share does not multiply.
    b = b.groupBy("_url", "_title").agg(F.min(match_key).alias(match_key))
    return a.join(b, ["_url", "_title"], "left").select(key, match_key)


def carry_forward(new: DataFrame, old: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Newly loaded documents with what users had entered in the old ones."""
    kept = old.select(key, *columns)
    return new.drop(*columns).join(kept, key, "left")


def differing(a: str, b: str, columns: Sequence[str]) -> Column:
    """Any of the columns differs between two aliases; null equals null."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def sync_columns(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the target that the source changes, with the source's columns, and ``updated``; rows alike come back as skipped."""
    both = source.alias("s").join(target.alias("t"), F.col(f"s.{key}") == F.col(f"t.{key}"))
    return both.select(F.col(f"t.{key}"), *[F.col(f"s.{c}").alias(c) for c in columns], differing("s", "t", columns).alias("updated"))


def holding_changes(now: DataFrame, before: DataFrame, key: str = "holding", owner: str = "resource", title: str = "title") -> DataFrame:
    """What to do with each holding: append, delete, move (from the old resource to the new), retitle or keep."""
    n, b = now.select(key, F.col(owner).alias("new_owner"), F.col(title).alias("new_title")), before.select(key, F.col(owner).alias("old_owner"), F.col(title).alias("old_title"))
    action = (
        F.when(F.col("old_owner").isNull(), "append")
        .when(F.col("new_owner").isNull(), "delete")
        .when(F.col("old_owner") != F.col("new_owner"), "move")
        .when(~F.col("old_title").eqNullSafe(F.col("new_title")), "retitle")
        .otherwise("keep")
    )
    return n.join(b, key, "full").withColumn("action", action)


def having(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows with a partner."""
    return df.join(other.select(key), key, "left_semi")


def lacking(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows without one."""
    return df.join(other.select(key), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Codes that no parent row explains, with counts; counted before the join."""
    used = child.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("n"))
    return used.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
