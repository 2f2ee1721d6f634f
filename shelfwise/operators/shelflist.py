"""Shelf order, manifests, order and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch, stored

#: Shelf order inside a location; missing values last, the id settles ties.
SHELF_ORDER = ("call_number_type", "call_number_sort", "volume_sort", "copy_number", "item_id")


def _last_nulls(names: Sequence[str]) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def ranked(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), out: str = "row_number", keep: Sequence[str] = ()) -> DataFrame:
    """Rows (of them the columns ``keep``, else all) with their number from 0 in a total order, counted anew in every group (null is one).

    One sort by ranges of (group, order) spreads a group of any size over all
    tasks.  The sorted rows are stored with their place in their range; what
    is counted after that is one row per group and range that it stands in.
    """
    at = F.monotonically_increasing_id()  # the range in the high bits, the place in it in the low ones
    kept = [*keep] or df.columns
    held = [F.col(f"`{c}`") for c in dict.fromkeys([*kept, *group])]  # sort columns that nobody asks for are not stored
    placed = stored(df.orderBy(*_last_nulls(group), *order).select(*held, at.alias("_at")), "ranked")
    runs = placed.groupBy(*group, F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group], F.shiftright("a._at", 33) == F.col("b._range"))
    number = (F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias(out)
    return placed.alias("a").join(runs.alias("b"), same).select(*[F.col(f"a.`{c}`") for c in kept], number)


def shelflist(items: DataFrame, order: Sequence[str] = SHELF_ORDER, location: str = "location_code", key: str = "item_id") -> DataFrame:
    """(location_code, row_number from 0, item_id); only key columns are sorted."""
    return ranked(items.select(location, *order), _last_nulls(order), [location], keep=[location, key]).select(location, "row_number", key)


def refresh_manifests(old: DataFrame, items: DataFrame, locations: Sequence[str]) -> DataFrame:
    """Manifests of the given locations anew, all others (and a null one) as they were."""
    touched = F.coalesce(F.col("location_code").isin(*locations), F.lit(False))
    return old.where(~touched).unionByName(shelflist(items.where(touched)))


def write_manifests(manifest: DataFrame, path: str) -> None:
    """Manifests as a table of one folder per location."""
    manifest.write.partitionBy("location_code").mode("overwrite").parquet(path)


def rewrite_manifests(items: DataFrame, locations: Sequence[str], path: str) -> None:
    """The manifests of some locations anew in a table of ``write_manifests``; files of the others are not touched.

    Only the folders of the given locations are replaced; that of a location
    without items is deleted, and one that is new is added.
    """
    spark = items.sparkSession
    fresh = shelflist(items.where(F.col("location_code").isin(*locations)))
    fresh.write.partitionBy("location_code").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    left = {r[0] for r in items.where(F.col("location_code").isin(*locations)).select("location_code").distinct().collect()}  # some of the given
    jvm = spark.sparkContext._jvm
    names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for code in sorted({*locations} - left):
        folder = jvm.org.apache.hadoop.fs.Path(path, f"location_code={names.escapePathName(code)}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_manifests``."""
    kinds = "row_number bigint, item_id string, location_code string"
    return spark.read.schema(kinds).parquet(path).select("location_code", "row_number", "item_id")


def manifest_lookup(manifest: DataFrame, ids: DataFrame, key: str = "item_id") -> DataFrame:
    """The row number of each id asked for; null if it stands nowhere."""
    return ids.join(manifest.select(key, "row_number"), key, "left")


def manifest_slice(manifest: DataFrame, first: int, last: int) -> DataFrame:
    """Rows from ``first`` to ``last`` inclusive in every location; negative numbers count from the end."""
    if first >= 0 and last >= 0:
        return manifest.where(F.col("row_number").between(first, last))
    sizes = manifest.groupBy("location_code").agg(F.count("*").alias("_size"))
    at = lambda n: F.lit(n) if n >= 0 else F.col("_size") + n
    same = F.col("m.location_code").eqNullSafe(F.col("s.location_code"))
    return manifest.alias("m").join(sizes.alias("s"), same).where(F.col("row_number").between(at(first), at(last))).select("m.*")


def manifest_splice(manifest: DataFrame, values: DataFrame, offset: int | None = None) -> DataFrame:
    """(position, id) rows written over those from ``offset`` on, or after the last."""
    if offset is None:
        end = manifest.agg(F.coalesce(F.max("row_number") + 1, F.lit(0)).alias("_end"))
        new = values.join(F.broadcast(end)).select((F.col("position") + F.col("_end")).alias("row_number"), "item_id")  # one row
    else:
        new = values.select((F.col("position") + offset).alias("row_number"), "item_id")
    return manifest.join(new.select("row_number"), "row_number", "left_anti").select("row_number", "item_id").unionByName(new)


def first_per_location(items: DataFrame, found: Column, order: Sequence[str] = SHELF_ORDER, key: str = "item_id") -> DataFrame:
    """In each location the first item in shelf order of those that meet a condition, how many meet it, and the first's row number in the whole location.

    The row number is a count of the items that stand before it: no location is sorted.
    """
    place = F.struct(*[x for n in order for x in (F.col(n).isNull(), F.col(n))])
    rows = items.select("location_code", key, place.alias("_place"), F.coalesce(found, F.lit(False)).alias("_found"))
    first = rows.where("_found").groupBy("location_code").agg(F.min(F.struct("_place", key)).alias("_least"), F.count("*").alias("n_items"))
    same = F.col("i.location_code").eqNullSafe(F.col("f.location_code"))
    before = rows.alias("i").join(first.alias("f"), same).groupBy("f.location_code").agg(F.count_if(F.struct("i._place", f"i.{key}") < F.col("f._least")).alias("row_number"))
    same = F.col("f.location_code").eqNullSafe(F.col("b.location_code"))
    return first.alias("f").join(before.alias("b"), same).select("f.location_code", F.col(f"f._least.{key}").alias(key), "f.n_items", "b.row_number")


def order_items(links: DataFrame, parent: str, order: str, number: str) -> DataFrame:
    """Position of each item in its bib: display order, missing last, then number."""
    w = Window.partitionBy(parent).orderBy(F.col(order).asc_nulls_last(), number)
    return links.withColumn("position", F.row_number().over(w) - 1)


def split_items(listed: DataFrame, column: str, n: int = 3) -> DataFrame:
    """The first ``n`` of an array, the rest, and whether there is one."""
    a = F.col(column)
    return listed.withColumn("first_items", F.slice(a, 1, n)).withColumn("more_items", F.slice(a, n + 1, F.greatest(F.size(a), F.lit(1)))).withColumn("has_more", F.size(a) > n)


def fields_of(varfields: DataFrame, code: str, first: bool = False) -> DataFrame:
    """Contents of one field type per record by occurrence; only the first if asked."""
    some = varfields.where(F.col("type_code") == code)
    if first:
        return some.groupBy("record_num").agg(F.min_by("content", "occ_num").alias("content"))
    return some.groupBy("record_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("occ_num", "content"))), lambda x: x["content"]).alias("contents"))


def order_varfields(varfields: DataFrame, by: Sequence[str] = ("marc_tag", "type_code", "occ_num")) -> DataFrame:
    """Place of each field of a record: groups of equal type code in tag order, then occurrence."""
    w = Window.partitionBy("record_num").orderBy(*_last_nulls(by))
    change = (F.lag("type_code").over(w).isNull() | (F.lag("type_code").over(w) != F.col("type_code"))).cast("int")
    return (
        varfields.where(F.col("marc_tag").isNotNull())
        .withColumn("_change", change)
        .withColumn("_group", F.sum("_change").over(w) - 1)
        .withColumn("place", F.col("_group") * 1000 + F.col("occ_num"))
        .drop("_change", "_group")
    )


def order_columns(keys: Sequence[str], columns: Mapping[str, str] | None = None, tie: str | None = None) -> list[Column]:
    """Sort columns of keys such as ``-price``; missing values last both ways."""
    out = []
    for k in keys:
        c = F.col((columns or {}).get(k.lstrip("-"), k.lstrip("-")))
        out.append(c.desc_nulls_last() if k.startswith("-") else c.asc_nulls_last())
    return [*out, F.col(tie)] if tie else out


def order_by(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str] | None = None, tie: str | None = None) -> DataFrame:
    return df.orderBy(*order_columns(keys, columns, tie))


def ordered_with_position(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str] | None = None, tie: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """W11 with the ``position`` (from 0) of every row; of its columns only ``keep``, if any are named."""
    return ranked(df, order_columns(keys, columns, tie), out="position", keep=keep)


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 20, most: int = 500) -> tuple[DataFrame, dict]:
    """Rows of one page, and (total, start_row, end_row, previous, next).

    For the first pages of a result that is asked once; ``Pages`` finds deep
    ones without sorting what stands before them.
    """
    limit, offset = min(max(limit, 0), most), max(offset, 0)
    return df.orderBy(*order).offset(offset).limit(limit), around(df.count(), offset, limit)


class Pages:
    """An ordered result kept in ranges, so that any page is found by the rows before it and read from its own range.

    One sort by ranges, written with a folder per range; how many rows each
    holds is kept (a number per range).
    """

    def __init__(self, df: DataFrame, order: Sequence[Column]):
        self.columns = df.columns
        placed = df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        self.path = scratch(df.sparkSession, "pages")
        placed.write.partitionBy("_range").option("compression", "zstd").parquet(self.path)
        self.rows = df.sparkSession.read.schema(placed.schema).parquet(self.path)
        self.starts, self.total = [], 0
        for r in self.rows.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
            self.starts.append((r["_range"], self.total, r["n"]))
            self.total += r["n"]

    def page(self, offset: int = 0, limit: int = 20, most: int = 500) -> tuple[DataFrame, dict]:
        """What ``page`` gives; only the ranges that hold the page are read."""
        limit, offset = min(max(limit, 0), most), max(offset, 0)
        wanted = F.lit(False)
        for number, start, n in self.starts:
            if start < offset + limit and offset < start + n:
                wanted = wanted | ((F.col("_range") == number) & F.col("_nth").between(offset - start, offset + limit - start - 1))
        rows = self.rows.where(wanted).orderBy("_range", "_nth").select(*self.columns)
        return rows, around(self.total, offset, limit)


def around(total: int, offset: int, limit: int) -> dict:
    """Where a page stands among all rows."""
    shown = max(0, min(limit, total - offset))
    return {
        "total": total,
        "start_row": offset if shown else None,
        "end_row": offset + shown - 1 if shown else None,
        "previous": max(0, offset - limit) if offset > 0 and limit else None,
        "next": offset + limit if limit and offset + limit < total else None,
    }


def call_number_matches(items: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` distinct call numbers in sort order."""
    return items.where(F.col("call_number").isNotNull()).groupBy("call_number").agg(F.min("call_number_sort").alias("sort")).orderBy(F.col("sort").asc_nulls_last(), "call_number").limit(n)


def get_one(df: DataFrame, **equal: object) -> Row | None:
    """The only row with these values; None without any, an error with several."""
    found = reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), equal.items(), df).limit(2).collect()
    if len(found) > 1:
        raise LookupError("more than one row")
    return found[0] if found else None
