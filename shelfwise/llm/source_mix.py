"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key.  Within a source the key space is cut
into equal ranges (the leading hexadecimal digits of the key), range totals are
summed in key order, the one range that holds the source's budget is sorted by
key, and the key at which the running word count meets the budget becomes the
source's cut.  A document is taken once for every whole epoch of its source
and once more if its key stands before the cut; of the rows that share the cut
key (one, or repeats of one) as many as come nearest to the budget.  Only one
row per (source, range), the keys of one range per source and the rows of one
key per source are ever ordered, so a source that holds a third of all rows is
no heavier for a task than any other.  Sources themselves are ordered in one
task, a row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shelflist import ranked
from .common import materialize, word_count


def mix_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Random key from id and content: rows that share an id do not share a key unless they are equal."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """(doc_id, source, size, mix_key) of every row."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        mix_key(F.col(id_col), F.col(text_col), seed).alias("mix_key"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row per source: source_size and target.

    Sources by code point, null last, take the weights in turn.  A target
    stops at ``max_epochs`` times the source's size and what is over is shared
    again by weight; the level at which that ends is found from running sums
    over the sources in order of the level at which each of them is full.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    weighted = per_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")).cast("long")
    ).withColumn("cap", F.col("source_size") * max_epochs)
    levels = (
        weighted.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left_over", F.col("total") - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("open", F.col("cap").cast("double") * F.col("weight_left") >= F.col("weight").cast("double") * F.col("left_over"))
        .withColumn("nth", F.row_number().over(filling))
    )
    found = levels.withColumn("first_open", F.min(F.when(F.col("open"), F.col("nth"))).over(everything)).withColumn(
        "level", F.min(F.when(F.col("nth") == F.col("first_open"), F.struct("left_over", "weight_left"))).over(everything)
    )
    return found.select(
        "source",
        "source_size",
        F.when(F.col("first_open").isNull() | (F.col("nth") < F.col("first_open")), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * F.col("level.left_over")).cast("double") / F.col("level.weight_left"))
        .alias("target"),
    )


def mix_plan(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, digits: int = 3) -> DataFrame:
    """One row per source: source_size, target, whole epochs, the cut key and how many rows of that key are taken once more (null where whole epochs meet the target).

    ``digits``: leading hexadecimal digits of the key that name a range, so
    that a source has 16 ** digits ranges at most.
    """
    targets = source_targets(sizes, weights, max_epochs)
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")
    ranges = sizes.groupBy("source", F.substring("mix_key", 1, digits).alias("key_range")).agg(F.sum("size").alias("range_size"))
    in_order = Window.partitionBy("r.source").orderBy("key_range")
    placed = (
        ranges.alias("r")
        .join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
        .where("rest > 0")
        .select("r.source", "key_range", "rest", "range_size", F.sum("range_size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("range_size") <= F.col("rest")))
        .select("source", "key_range", (F.col("rest") - (F.col("upto") - F.col("range_size"))).alias("room"))
    )
    by_key = Window.partitionBy("source").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("room") - (F.col("upto") - F.col("key_size"))
    cuts = (
        sizes.withColumn("own_range", F.substring("mix_key", 1, digits))
        .alias("s")
        .join(placed.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.own_range") == F.col("c.key_range")))
        .groupBy("s.source", "c.room", "s.mix_key")
        .agg(F.sum("s.size").alias("key_size"), F.max("s.size").alias("row_size"))
        .withColumn("upto", F.sum("key_size").over(by_key))
        .where((F.col("upto") > F.col("room")) & (left >= 0))
        .select("source", F.col("mix_key").alias("cut_key"), F.floor(left / F.col("row_size") + 0.5).cast("long").alias("cut_rows"))
    )
    return (
        plan.alias("p")
        .join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
        .select("p.source", "source_size", "target", "epochs", "cut_key", "cut_rows")
    )


def _taken(rows: DataFrame) -> DataFrame:
    """Rows with source, mix_key, nth_row and their source's epochs, cut_key and cut_rows: the same with ``copies``, how often each is taken.

    ``nth_row``, given where the rows are read, tells repeats of the cut key apart.
    """
    key, cut = F.col("mix_key"), F.col("cut_key")
    at_cut = F.coalesce(key == cut, F.lit(False))
    sure = rows.where(~at_cut).withColumn("copies", F.col("epochs") + F.coalesce((key < cut).cast("long"), F.lit(0)))
    counted = ranked(rows.where(at_cut), [F.col("nth_row")], ["source"], "_nth")
    return sure.unionByName(counted.withColumn("copies", F.col("epochs") + (F.col("_nth") < F.col("cut_rows")).cast("long")).drop("_nth"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row.

    A null text has size 0, a null source is a source of its own, rows that are
    equal are taken one by one, an empty table gives an empty result.
    """
    sizes = materialize(sized(docs, id_col, text_col, source_col, seed).withColumn("nth_row", F.monotonically_increasing_id()), "mix-sizes")
    plan = materialize(mix_plan(sizes, weights, max_epochs), "mix-cuts")
    planned = sizes.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.*", "source_size", "target", "epochs", "cut_key", "cut_rows")
    return _taken(planned).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, its columns unchanged; rows without words as often as their source's epochs, and once more before the cut."""
    sizes = materialize(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    plan = materialize(mix_plan(sizes, weights, max_epochs).select("source", "epochs", "cut_key", "cut_rows"), "mix-cuts")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source_col).alias("source"), mix_key(F.col(id_col), F.col(text_col), seed).alias("mix_key"), F.monotonically_increasing_id().alias("nth_row")
    )
    planned = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("_row", "r.source", "mix_key", "nth_row", "epochs", "cut_key", "cut_rows")
    taken = _taken(planned).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS mix_key
  FROM documents),
per_source AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap, sum(source_size) OVER () AS total FROM per_source),
levels AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth FROM weighted),
opened AS (SELECT *, min(CASE WHEN cap * weight_left >= weight * left_over THEN nth END) OVER () AS first_open FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN first_open IS NULL OR nth < first_open THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * (SELECT min(left_over) FROM opened WHERE nth = first_open) AS DOUBLE)
                   / (SELECT min(weight_left) FROM opened WHERE nth = first_open) END AS target FROM opened),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
each AS (
  SELECT *, row_number() OVER (PARTITION BY source, mix_key) AS nth, sum(size) OVER (PARTITION BY source, mix_key) AS key_size FROM sized),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY mix_key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - key_size AS before FROM each),
decided AS (
  SELECT r.doc_id, r.size, p.source_size, p.target,
         p.epochs + CASE WHEN p.target - p.epochs * p.source_size <= 0 OR r.before > p.target - p.epochs * p.source_size THEN 0
                         WHEN r.before + r.key_size <= p.target - p.epochs * p.source_size THEN 1
                         WHEN r.nth <= floor((p.target - p.epochs * p.source_size - r.before) / r.size + 0.5) THEN 1 ELSE 0 END AS copies
  FROM running r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(copies * size AS BIGINT) AS taken FROM decided
"""
