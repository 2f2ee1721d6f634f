"""Keeping documents current: upserts, deletions and field edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import flag_diff
from .shelflist import shelflist


def upsert(docs: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """New documents take the place of old ones with the same key, wholly."""
    return docs.join(updates.select(key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def delete_by_key(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """S3"""
    return docs.join(keys.select(key), key, "left_anti")


def clear_type(docs: DataFrame, name: str, type_col: str = "type") -> DataFrame:
    """Documents of all other types, those without a type too."""
    return docs.where(~F.coalesce(F.col(type_col) == name, F.lit(False)))


def reindex(docs: DataFrame, new: DataFrame, name: str, type_col: str = "type") -> DataFrame:
    """One type anew; an empty set changes nothing."""
    return docs if new.isEmpty() else clear_type(docs, name, type_col).unionByName(new)


def apply_changes(docs: DataFrame, changed: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Exports first, then deletions."""
    return delete_by_key(upsert(docs, changed, key), deleted, key)


def set_item_fields(items: DataFrame, locations: Sequence[str], data: DataFrame, default: Mapping[str, object], key: str = "item_id") -> DataFrame:
    """Items of some locations get the values of their row in ``data``, or the defaults.

    A column that ``data`` holds is taken from its row, null included (which clears it).
    """
    columns = sorted({c for c in data.columns if c != key} | set(default))
    given = data.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns if c in data.columns], F.lit(True).alias("_given"))
    out, here = items.join(given, key, "left"), F.col("location_code").isin(*locations)
    kinds = dict(items.dtypes)
    for c in columns:
        otherwise = F.lit(default[c]).cast(kinds[c]) if c in default else F.col(c)
        new = F.when(F.coalesce("_given", F.lit(False)), F.col(f"_new_{c}")).otherwise(otherwise) if c in data.columns else otherwise
        out = out.withColumn(c, F.when(here, new).otherwise(F.col(c)))
    return out.select(*items.columns)


def clear_inventory(items: DataFrame, locations: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """E3"""
    here = F.col("location_code").isin(*locations)
    return items.withColumns({c: F.when(~F.coalesce(here, F.lit(False)), F.col(c)) for c in columns})


def auto_notes(old_status: Column, new_status: Column, old_flags: Column, new_flags: Column, now: str, supplied: Column | None = None) -> Column:
    """System notes for a changed status and for every flag cleared or set, unless notes are supplied."""
    note = lambda user, text: F.concat_ws("|", F.lit(now), F.lit(user), text)
    status = F.when(
        ~old_status.eqNullSafe(new_status),
        F.array(note("@SYSTEMLOG-STATUS", F.when(new_status.isNull(), "BATCH-PROCESS cleared status").otherwise(F.concat(F.lit("BATCH-PROCESS set status to "), new_status)))),
    ).otherwise(F.array().cast("array<string>"))
    cleared, added = flag_diff(old_flags, new_flags)
    flag = lambda verb: lambda f: note("@SYSTEMLOG-FLAG", F.concat(F.lit(f"BATCH-PROCESS {verb} flag "), f))
    made = F.concat(status, F.transform(F.array_sort(cleared), flag("cleared")), F.transform(F.array_sort(added), flag("set")))
    return made if supplied is None else F.coalesce(supplied, made)


def apply_patches(docs: DataFrame, patches: DataFrame, writeable: Sequence[str], key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, changed rows, rejected patches) from patches (key, field, value as text, seq).

    The last patch of a field wins.  A patch is rejected if its field cannot be
    written, its value is not of the field's type or its document is missing.
    """
    kinds = {n: t for n, t in docs.dtypes if n in writeable}
    w = Window.partitionBy(key, "field").orderBy(F.desc("seq"))
    last = patches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    castable = reduce(lambda c, kv: c.when(F.col("field") == kv[0], F.col("value").isNull() | F.expr(f"try_cast(value AS {kv[1]})").isNotNull()), list(kinds.items())[1:], F.when(F.col("field") == next(iter(kinds)), F.col("value").isNull() | F.expr(f"try_cast(value AS {next(iter(kinds.values()))})").isNotNull()))
    known = docs.select(key, F.lit(True).alias("_known"))
    judged = last.join(known, key, "left").withColumn("reason", F.when(F.col("_known").isNull(), "no such document").when(~F.col("field").isin(*writeable), "not writeable").when(~castable, "not of the field's type"))
    good = judged.where("reason IS NULL").groupBy(key).pivot("field", list(writeable)).agg(F.first(F.struct("value")))
    wide = docs.join(good.select(key, *[F.col(c).alias(f"_p_{c}") for c in writeable]), key, "left")
    new = {c: F.when(F.col(f"_p_{c}").isNull(), F.col(c)).otherwise(F.col(f"_p_{c}.value").cast(kinds[c])) for c in writeable}
    changed = reduce(lambda a, b: a | b, [~new[c].eqNullSafe(F.col(c)) for c in writeable])
    out = wide.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns], changed.alias("_changed"))
    return out.drop("_changed"), out.where("_changed").drop("_changed"), judged.where("reason IS NOT NULL").select(key, "field", "value", "reason")


def patch_upsert(users: DataFrame, batch: DataFrame, key: str, row_no: str, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """E5: (users with the batch merged in, bad rows with their number): values that are not null overwrite."""
    bad = F.col(key).isNull()
    for c in required:
        bad = bad | F.col(c).isNull()
    columns = [c for c in users.columns if c != key]
    n = batch.where(~bad).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return users.join(n, key, "full").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns]), batch.where(bad)


def rebuild_manifests(items: DataFrame, locations: Sequence[str]) -> DataFrame:
    """Manifests of the given locations that have items."""
    return shelflist(items.where(F.col("location_code").isin(*locations)))


def maintain_holdings(stored: DataFrame, upserts: DataFrame, deleted: DataFrame, key: str = "holding") -> DataFrame:
    """The (holding, resource, position) table after a run."""
    return delete_by_key(upsert(stored, upserts, key), deleted, key)


def holdings_by_resource(stored: DataFrame) -> DataFrame:
    """The ordered holdings of each resource."""
    return stored.groupBy("resource").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "holding"))), lambda x: x["holding"]).alias("holdings"))


def locations(docs: DataFrame, type_name: str = "Location") -> DataFrame:
    """Valid location codes, sorted."""
    return docs.where(F.col("type") == type_name).select("code").distinct().orderBy("code")
