"""Rule tables applied by joins and conditional expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Values of one or several columns to a result."""

    columns: tuple[str, ...]
    mapping: Mapping[tuple, object]


def apply_rules(df: DataFrame, rules: Sequence[Rule], default: object, out: str) -> DataFrame:
    """The result of the last rule that matches, else the default.

    A rule is a literal table of its writer, so its size is that of the code;
    each is joined as a small DataFrame.
    """
    found = []
    for i, rule in enumerate(rules):
        rows = [(*k, v) for k, v in rule.mapping.items()]
        names = [f"_{i}_{c}" for c in rule.columns]
        table = df.sparkSession.createDataFrame(rows, [*names, f"_{i}_out"])
        on = None
        for c, n in zip(rule.columns, names, strict=True):
            on = F.col(c) == F.col(n) if on is None else on & (F.col(c) == F.col(n))
        df = df.join(F.broadcast(table), on, "left").drop(*names)
        found.append(F.col(f"_{i}_out"))
    return df.withColumn(out, F.coalesce(*reversed(found), F.lit(default))).drop(*[f"_{i}_out" for i in range(len(rules))])


#: Item statuses and types that rule out a request, and the locations of the other ways (fixed values).
NOT_REQUESTABLE_STATUSES = tuple("efijmnopwyz")
NOT_REQUESTABLE_TYPES = (20, 29, 69, 74, 112)
STORAGE_LOCATION = "jlf"
READING_ROOM_LOCATIONS = ("w4spe", "xspe", "w4mr1", "w4mr2", "w4mr3", "w4mrb", "w4mrx", "w4mbg", "w4mwf")
FINDING_AID_LOCATIONS = ("w4spc", "xspc")


def requestable(items: DataFrame, barred_locations: Sequence[str], barred_pairs: Sequence[tuple[int, str]] = (), statuses: Sequence[str] = NOT_REQUESTABLE_STATUSES, types: Sequence[int] = NOT_REQUESTABLE_TYPES, storage: str = STORAGE_LOCATION, reading_room: Sequence[str] = READING_ROOM_LOCATIONS, finding_aid: Sequence[str] = FINDING_AID_LOCATIONS) -> DataFrame:
    """How an item can be asked for: storage before reading room before catalogue before finding aid; null if not at all."""
    false = lambda columns, keys: Rule(columns, {k: False for k in keys})
    rules = [false(("location_code",), [(x,) for x in barred_locations]), false(("status_code",), [(x,) for x in statuses]), false(("item_type_code",), [(x,) for x in types])]
    if barred_pairs:
        rules.append(false(("item_type_code", "location_code"), barred_pairs))
    ruled = apply_rules(items, [r for r in rules if r.mapping], True, "_catalogue")
    at = lambda codes: F.coalesce(F.col("location_code").isin(*codes), F.lit(False))
    way = F.when(at([storage]), "jlf").when(at(reading_room), "aeon").when(F.col("_catalogue"), "catalog").when(at(finding_aid), "finding_aid")
    return ruled.withColumn("requestability", way).drop("_catalogue")


def collections(items: DataFrame, members: DataFrame, key: str = "item_id") -> DataFrame:
    """The sorted collections that an item's location belongs to; ``members`` is (collection, location_code)."""
    named = members.groupBy("location_code").agg(F.array_sort(F.collect_set("collection")).alias("collections"))
    return items.join(named, "location_code", "left").withColumn("collections", F.coalesce("collections", F.array().cast("array<string>")))


#: Locations that are online or public, and the buildings of others by the start of their code, but for some codes (fixed patterns).
ONLINE_LOCATION, PUBLIC_LOCATION = "www$", "^(czm|f|jlf|k|r|s|w)"
BUILDINGS = (("^w", "w"), ("^czm", "czm"), ("^frsco", "frsco"), ("^fip", "fip"), ("^fl", "fl"), ("^s", "s"), ("^r", "r"), ("(^x|^jlf$)", "x"))
NO_BUILDING = ("spec", "xprsv", "xts")
ONLINE, PHYSICAL = "Online", "At the Library"


def location_places(locations: DataFrame, online: str = ONLINE_LOCATION, public: str = PUBLIC_LOCATION, buildings: Sequence[tuple[str, str]] = BUILDINGS, no_building: Sequence[str] = NO_BUILDING) -> DataFrame:
    """U4: (location_code, online, public, shelf, building) of locations (location_code, label): what their codes say, with labels."""
    code = F.col("location_code")
    own = locations.select(code, F.col("label").alias("shelf"), code.rlike(online).alias("online"), code.rlike(public).alias("public"), F.when(~code.isin(*no_building), first_match(code, buildings, F.lit(None))).alias("_building"))
    labels = locations.select(code.alias("_building"), F.col("label").alias("building"))
    return own.join(labels, "_building", "left").drop("_building")


def access_facets(bibs: DataFrame, items: DataFrame, bib_locations: DataFrame, places: DataFrame, members: DataFrame, key: str = "bib_num") -> DataFrame:
    """U4: sorted access, building, shelf and collection facets of a bib's unsuppressed items; bibs without such items take their own locations.

    ``places`` is (location_code, online, public, shelf, building), one row a
    location, ``members`` (collection, location_code).  An online location
    gives no building or shelf; a shelf is shown if it is public and not named
    like its building.  Locations count once, however many items stand there.
    """
    own = items.where(~F.coalesce("suppressed", F.lit(False))).select(key, "location_code").distinct()
    # Tables of bibs meet in the tasks that have them, never on the driver.
    stand_in = bib_locations.select(key, "location_code").distinct().join(own.select(key).distinct().hint("shuffle_hash"), key, "left_anti")
    named = members.groupBy("location_code").agg(F.collect_set("collection").alias("_collections"))
    at = own.unionByName(stand_in).join(places, "location_code", "left").join(named, "location_code", "left")
    online = F.coalesce("online", F.lit(False))
    building = F.when(~online, F.col("building"))
    shelf = F.when(~online & F.coalesce("public", F.lit(False)) & ~F.col("shelf").eqNullSafe(F.col("building")), F.col("shelf"))
    access = F.when(online, ONLINE).when(building.isNotNull(), PHYSICAL)
    sets = {"access": access, "buildings": building, "shelves": shelf}
    found = at.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()], F.array_sort(F.array_distinct(F.flatten(F.collect_set("_collections")))).alias("collections"))
    empty = F.array().cast("array<string>")
    return bibs.join(found.hint("shuffle_hash"), key, "left").withColumns({n: F.coalesce(n, empty) for n in (*sets, "collections")})


def resource_types(bibs: DataFrame, coded: DataFrame, base_types: DataFrame, formats: DataFrame, combined: DataFrame, overrides: Sequence[tuple[str, str]] = (), key: str = "record_num", call_number: str = "call_number") -> DataFrame:
    """Base type, sorted formats and resource type of a bib.

    ``coded`` (key, position, byte) are fixed-field bytes; ``base_types``
    (base_code, base_type) explains the bib's own code; ``formats`` (position,
    byte, format) names the formats; ``combined`` (base_type, format_key,
    resource_type) names the resource for a base type and its formats joined by
    ``+``; without an entry the base type stands.  ``overrides`` (pattern,
    type) on the call number go first.
    """
    named = coded.join(formats, ["position", "byte"]).groupBy(key).agg(F.array_sort(F.collect_set("format")).alias("formats"))
    out = bibs.join(base_types, "base_code", "left").join(named, key, "left").withColumn("formats", F.coalesce("formats", F.array().cast("array<string>"))).withColumn("format_key", F.array_join("formats", "+"))
    out = out.join(combined, ["base_type", "format_key"], "left")
    by_number = None
    for pattern, name in overrides:
        hit = F.col(call_number).rlike(pattern)
        by_number = F.when(hit, name) if by_number is None else by_number.when(hit, name)
    choices = ([by_number] if by_number is not None else []) + [F.col("resource_type"), F.col("base_type")]
    return out.withColumn("resource_type", F.coalesce(*choices))


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    """Result of the first pattern that a value meets."""
    out = None
    for pattern, result in rules:
        out = F.when(c.rlike(pattern), result) if out is None else out.when(c.rlike(pattern), result)
    return default if out is None else out.otherwise(default)
