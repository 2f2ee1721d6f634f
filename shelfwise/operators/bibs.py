"""Whole bib documents: every field of a record is read once, what it tells meets once by record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.arrays import subfield_array
from ..functions.project import record_boost
from ..sources.tables import stored
from . import documents as D
from . import identifiers as I
from . import subjects as S
from .resource_types import resource_type_info

_STRINGS = "array<string>"
#: Subfields of 041 that name languages (fixed values).
LANGUAGE_CODES = tuple(code for code, _ in D.LANGUAGE_NOTES)


@dataclass(frozen=True)
class BibRules:
    """What a library decides for its bib documents.

    ``call_numbers`` are (type code, tag, kind), the first that a record has
    counts; ``notes`` by tag, ``note_types`` by type code of other fields,
    ``lists`` by tag: target columns; ``languages`` names of codes; hosts of
    bookings, of digital-library pictures, and of the library itself.
    """

    call_numbers: Sequence[tuple[str, str | None, str]]
    booking_host: str
    picture_hosts: Sequence[str]
    local_host: str
    reserve_url: str
    languages: Mapping[str, str]
    subdivision_patterns: Sequence[tuple[str, Sequence[tuple[str, str]]]] = ()
    notes: Mapping[str, str] = field(default_factory=lambda: {"502": "dissertation_notes", "505": "toc_notes", "520": "summary_notes", "546": "language_notes"})
    note_types: Mapping[str, str] = field(default_factory=lambda: {"n": "notes"})
    lists: Mapping[str, str] = field(default_factory=lambda: {"250": "editions_display", "866": "library_has_display"})
    last_year: int = 2029
    this_year: int = 2024


def _pick(key: Column, mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key] if mapping else F.lit(None).cast("string")


def statement_lines(tag: Column, ind2: Column, subs: Column) -> Column:
    """(kind, statement) of a 260 or 264: each statement ends with its date (``c``); ``e f g`` are a manufacture statement, a date of 260 may hold a copyright date too."""
    line = "struct<open:array<string>,lines:array<struct<kind:string,value:string>>>"
    own = F.coalesce(_pick(ind2, D.STATEMENT_KINDS), F.lit("publication"))
    dated = r",? *(?:©|\(c\)|c|copyright ) *([0-9]{4})$"
    told = F.filter(F.transform(subs, lambda s: F.struct(s["code"].alias("code"), F.trim(s["value"]).alias("value"))), lambda s: s["value"] != "")
    one = lambda kind, parts: F.filter(F.array(F.struct(kind.alias("kind"), F.array_join(parts, " ").alias("value"))), lambda x: x["value"] != "")

    def fold(acc: Column, s: Column) -> Column:
        old_date = (tag == "260") & (s["code"] == "c") & s["value"].rlike(dated)
        value = F.when(old_date, F.regexp_replace(s["value"], dated, "")).otherwise(s["value"])
        open_ = F.concat(acc["open"], F.filter(F.array(value), lambda v: v != ""))
        right = F.when(old_date, F.array(F.struct(F.lit("copyright").alias("kind"), F.concat(F.lit("©"), F.regexp_extract(s["value"], dated, 1)).alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
        ends = s["code"] == "c"
        return F.struct(F.when(ends, F.array().cast(_STRINGS)).otherwise(open_).alias("open"), F.when(ends, F.concat(acc["lines"], one(own, open_), right)).otherwise(acc["lines"]).alias("lines"))

    none = F.struct(F.array().cast(_STRINGS).alias("open"), F.array().cast("array<struct<kind:string,value:string>>").alias("lines")).cast(line)
    parts = F.aggregate(F.filter(told, lambda s: s["code"].isin("a", "b", "c")), none, fold, lambda acc: F.concat(acc["lines"], one(own, acc["open"])))
    made = F.transform(F.filter(told, lambda s: s["code"].isin("e", "f", "g")), lambda s: s["value"])
    return F.transform(F.concat(parts, one(F.lit("manufacture"), made)), lambda x: F.struct(x["kind"].alias("kind"), K.tidy(x["value"]).alias("value")))


def field_rows(varfields: DataFrame, rules: BibRules) -> DataFrame:
    """One row per value that a field tells: (record_num, part, marc_tag, occ_num, place, value, number, url).

    All jobs over single fields in one pass: call numbers (D2), links (D10),
    statements (D15), languages (D16), standard and control numbers (D17, D18),
    games (D19), notes (D24), lists (D26), control fields (D12, U5).  ``part``
    is the column that values are for, or the job that settles them later.
    """
    tag = F.coalesce("marc_tag", F.lit(""))
    fields = I.numbers_of(varfields.withColumn("marc_tag", tag))
    fields = fields.withColumn("_subs", subfield_array(F.col("content")))
    tag, subs, content = F.col("marc_tag"), F.col("_subs"), F.col("content")
    text = F.trim(F.regexp_replace(F.regexp_replace(content, r"^\|.", ""), r"\|.", " "))
    of = lambda *codes: F.transform(F.filter(subs, lambda s: s["code"].isin(*codes)), lambda s: s["value"])
    null = F.lit(None)
    url = F.struct(F.get(of("u"), F.lit(0)).alias("url"), F.col("ind2").alias("ind2"), of("3", "z").alias("notes"), of("y").alias("labels"), F.get(of("t"), F.lit(0)).alias("title"))
    no_number, no_url = null.cast(fields.schema["numbers"].dataType.elementType), null.cast("struct<url:string,ind2:string,notes:array<string>,labels:array<string>,title:string>")
    row = lambda part, value, number=no_number, url=no_url: F.struct(part.alias("part"), value.alias("value"), number.alias("number"), url.alias("url"))

    call = None
    for i, (code, of_tag, kind) in enumerate(rules.call_numbers):
        hit = (F.col("type_code") == code) & (tag == (of_tag or ""))
        call = F.when(hit, f"call:{i:03d}:{kind}") if call is None else call.when(hit, f"call:{i:03d}:{kind}")
    target = F.coalesce(_pick(tag, rules.notes), F.when(~tag.isin(*rules.notes), _pick(F.col("type_code"), rules.note_types)))
    some = lambda test, rows: F.when(F.coalesce(test, F.lit(False)), rows)
    one = lambda part, value: F.array(row(part, value))
    languages = F.flatten(F.transform(F.filter(subs, lambda s: s["code"].isin(*LANGUAGE_CODES)), lambda s: F.transform(F.regexp_extract_all(s["value"], F.lit("[a-z]{3}"), F.lit(0)), lambda c: row(F.concat(F.lit("language:"), s["code"]), c))))
    jobs = [
        some(call.isNotNull(), one(call, text)),
        some(tag.isin(*I.STANDARD_TAGS), F.transform("numbers", lambda n: row(F.lit("standard"), n["number"], n))),
        some(tag.isin(*I.CONTROL_TAGS), F.transform("numbers", lambda n: row(F.lit("control"), n["number"], n))),
        some(tag.isin("001", "007", "008"), one(tag, content)),
        some(tag == "041", languages),
        some(tag.isin("260", "264"), F.transform(statement_lines(tag, F.col("ind2"), subs), lambda x: row(F.concat(x["kind"], F.lit("_display")), x["value"]))),
        some(tag == "592", F.transform(of("a"), lambda v: row(F.lit("games"), v))),
        some(tag.isin("856", "962"), F.array(row(F.lit("url"), F.coalesce(url["url"], F.lit("")), url=url))),
        some(target.isNotNull(), one(target, text)),
        some(tag.isin(*rules.lists), one(_pick(tag, rules.lists), text)),
    ]
    told = F.flatten(F.filter(F.array(*jobs), lambda a: a.isNotNull()))
    return fields.select("record_num", "marc_tag", "occ_num", F.posexplode(told).alias("place", "_r")).select("record_num", "marc_tag", "occ_num", "place", "_r.*")


def record_parts(varfields: DataFrame, mapping: DataFrame, rules: BibRules) -> DataFrame:
    """(record_num, values, numbers, urls, headings): what all fields of a record tell, each list in the order of fields; one shuffle of all rows, by record."""
    headed = F.coalesce(F.col("marc_tag").isin(*S.SUBJECT_TAGS), F.lit(False))
    rows = field_rows(varfields.where(~headed | F.col("type_code").isin(*rules.note_types)), rules)
    headings = S.heading_rows(varfields.where(headed), mapping, rules.subdivision_patterns)
    heading = F.struct(*[F.col(c) for c in S.ROW])
    met = rows.unionByName(headings.select("record_num", "marc_tag", "occ_num", "place", F.lit("heading").alias("part"), heading.alias("heading")), allowMissingColumns=True)
    order = [F.col(c) for c in ("marc_tag", "occ_num", "place")]
    listed = lambda test, *columns: F.array_sort(F.collect_list(F.when(test, F.struct(*order, *columns))))
    part = F.col("part")
    return met.groupBy("record_num").agg(
        listed(~part.isin("standard", "control", "url", "heading"), part, F.col("value")).alias("values"),
        listed(part.isin("standard", "control"), part, F.col("number")).alias("numbers"),
        listed(part == "url", F.col("url")).alias("urls"),
        F.array_sort(F.collect_list(F.col("heading"))).alias("headings"),
    )


def _coded_dates(f008: Column, serial: Column, rules: BibRules) -> Column:
    return D.interpret_dates(F.substring(f008, 7, 1), F.substring(f008, 8, 4), F.substring(f008, 12, 4), serial, rules.last_year, rules.this_year)


def settled(parts: DataFrame, rules: BibRules) -> DataFrame:
    """``record_parts`` joined to records (level, serial, bcode2, online, locations, item_numbers): with the columns that all jobs fill.

    Lists extend in the order of fields; where a column holds one value the
    first that is not empty wins.  Null where a record tells nothing.
    """
    none = F.array().cast(_STRINGS)
    values = F.col("values")
    of = lambda *names: F.transform(F.filter(values, lambda v: v["part"].isin(*names)), lambda v: v["value"])
    first = lambda name: F.get(of(name), F.lit(0))
    full = lambda c: F.when(F.size(c) > 0, c)

    # call numbers: those of the first spec that has any, then the items'
    calls = F.filter(values, lambda v: v["part"].startswith("call:"))
    best = F.array_min(F.transform(calls, lambda v: v["part"]))
    own = F.transform(F.filter(calls, lambda v: v["part"] == best), lambda v: F.struct(v["value"].alias("call_number"), F.split(v["part"], ":")[2].alias("kind")))
    out = parts.withColumn("_calls", F.concat(F.coalesce(own, F.array().cast("array<struct<call_number:string,kind:string>>")), F.coalesce("item_numbers", F.array().cast("array<struct<call_number:string,kind:string>>"))))
    numbers = D.call_number_columns(F.col("_calls"))
    out = out.withColumns({"call_number_type": F.get(own, F.lit(0))["kind"], "call_numbers_display": full(numbers["call_numbers"]), "call_numbers_search": full(numbers["call_numbers_search"]), "sudocs_display": full(numbers["sudocs"]), "sudocs_search": full(numbers["sudocs_search"])})

    # statements and dates
    kinds = [f"{k}_display" for k in sorted(set(D.STATEMENT_KINDS.values()))]
    out = out.withColumns({k: full(of(k)) for k in kinds})
    out = out.withColumn("_dates", _coded_dates(first("008"), F.coalesce("serial", F.lit(False)), rules))
    said = F.flatten(F.transform(of(*kinds), lambda s: D.extract_years(s, rules.last_year)))
    out = out.withColumn("_said", F.filter(F.transform(said, lambda y: F.struct(*[c.alias(n) for n, c in zip(("low", "high"), D.coded_bounds(y["first"], rules.last_year), strict=True)])), lambda y: y["low"].isNotNull()))
    coded = F.when(F.col("_dates.low").isNotNull() & (F.col("_dates.high") >= F.col("_dates.low")), F.array(F.struct(F.col("_dates.low").alias("low"), F.col("_dates.high").alias("high"))))
    ranges = F.concat(F.coalesce(coded, F.array().cast("array<struct<low:int,high:int>>")), F.col("_said"))
    years = F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["low"], r["high"])))))
    label = D.range_label(F.when(F.col("_dates.low").isNotNull(), F.substring(first("008"), 8, 4)), F.nullif(F.trim(F.substring(first("008"), 12, 4)), F.lit("")))
    year = F.coalesce(F.col("_dates.low"), F.get("_said", F.lit(0))["low"])
    out = out.withColumns({"publication_year_range_facet": full(years), "publication_dates_label": F.nullif(label, F.lit("")), "publication_year": year})
    out = out.withColumn("record_boost", record_boost(F.col("publication_year"), F.col("level"), rules.this_year))

    # languages: the coded one, then those of 041; notes of 546, else made from the codes
    named = lambda of, code: F.struct(of.alias("of"), _pick(code, rules.languages).alias("name"))
    main = F.transform(F.slice(of("008"), 1, 1), lambda f: named(F.lit("a"), F.substring(f, 36, 3)))
    more = F.transform(F.filter(values, lambda v: v["part"].startswith("language:")), lambda v: named(F.substring(v["part"], 10, 1), v["value"]))
    out = out.withColumn("_named", F.filter(F.concat(main, more), lambda x: x["name"].isNotNull()))
    of_kind = [F.array_distinct(F.transform(F.filter("_named", _is(code)), lambda x: x["name"])) for code in LANGUAGE_CODES]
    made = F.filter(F.array(*[F.when(F.size(names) > 0, F.concat(F.lit(f"{text}: "), F.array_join(names, ", "))) for names, (_, text) in zip(of_kind, D.LANGUAGE_NOTES, strict=True)]), lambda n: n.isNotNull())
    targets = [*dict.fromkeys([*rules.notes.values(), *rules.note_types.values(), *rules.lists.values()])]
    out = out.withColumns({t: full(of(t)) for t in targets})
    out = out.withColumns({"languages": full(F.array_distinct(F.transform("_named", lambda x: x["name"]))), "language_notes": F.coalesce(F.col("language_notes"), full(made)) if "language_notes" in targets else full(made)})

    # numbers, headings
    entries = lambda name: F.transform(F.filter("numbers", lambda n: n["part"] == name), lambda n: n["number"])
    out = out.withColumns(I.standard_number_columns(entries("standard")))
    last_001 = F.try_element_at(of("001"), F.lit(-1))
    out = out.withColumn("_control", I.settled_control_numbers(entries("control"), last_001))
    out = out.withColumns(I.control_number_columns("_control"))
    out = out.withColumn("headings", S.first_fields(F.col("headings")))
    out = out.withColumns(S.heading_columns(F.col("headings")))

    # links, games, type
    urls = F.transform("urls", lambda u: F.struct(u["marc_tag"].alias("tag"), u["occ_num"].alias("position"), u["url"]["ind2"].alias("ind2"), u["url"]["url"].alias("url"), u["url"]["notes"].alias("notes"), u["url"]["labels"].alias("labels"), u["url"]["title"].alias("title")))
    reserve = F.concat(F.lit(rules.reserve_url), F.col("record_num").cast("string"))
    links = F.transform(D.record_links(urls, rules.booking_host, reserve, F.col("online")), lambda u: F.to_json(F.struct(u["url"].alias("u"), u["note"].alias("n"), u["label"].alias("l"), u["url_type"].alias("t"))))
    games = lambda facet: full(F.transform(F.filter("_games", _facet(facet)), lambda g: g["label"]))
    tokens = F.flatten(F.transform(of("games"), D.game_labels))
    at_games = F.exists(F.coalesce("locations", none), lambda l: l.startswith(D.GAME_LOCATIONS))
    out = out.withColumn("_games", F.when(at_games, tokens))
    out = out.withColumns({"urls_json": full(links), "thumbnail_url": D.record_thumbnail(urls, rules.picture_hosts, rules.local_host), "games_ages_facet": games("a"), "games_duration_facet": games("d"), "games_players_facet": games("p")})
    out = out.withColumns({"f007s": of("007"), "f008s": of("008"), "call_numbers": F.transform("_calls", lambda c: c["call_number"])})
    out = resource_type_info(out)
    return out.drop("values", "numbers", "urls", "headings", "_calls", "_dates", "_said", "_named", "_control", "_games", "f007s", "f008s", "call_numbers", "item_numbers")


def _is(code: str):
    return lambda x: x["of"] == code


def _facet(name: str):
    return lambda g: g["facet"] == name


def bib_documents(records: DataFrame, varfields: DataFrame, items: DataFrame, mapping: DataFrame, rules: BibRules, others: Sequence[DataFrame] = (), required: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, records that lack the required column).

    ``records`` has record_num, level, serial, bcode2; ``varfields``
    record_num, type_code, marc_tag, ind1, ind2, occ_num, content; ``items``
    record_num, item_id, call_number, call_number_type, location_code,
    display_order, suppressed.  ``others`` are jobs over tables of their own
    (names, titles, links, item JSON, access, dates added), a row per
    record_num each.  Fields are shuffled once, by record; items, records and
    the others meet them there.
    """
    shown = ~F.coalesce(F.col("suppressed"), F.lit(False))
    place = [F.coalesce(F.col("display_order").cast("long"), F.lit(2**31)).alias("o"), F.col("item_id").alias("i")]
    number = F.when(shown & F.col("call_number").isNotNull(), F.struct(*place, F.struct("call_number", F.col("call_number_type").alias("kind")).alias("n")))
    of_items = items.groupBy("record_num").agg(
        F.transform(F.array_sort(F.collect_list(number)), lambda x: x["n"]).alias("item_numbers"),
        F.bool_or(F.col("location_code").endswith("www")).alias("online"),
        F.array_sort(F.collect_set("location_code")).alias("locations"),
    )
    met = records
    for told in (record_parts(varfields, mapping, rules), of_items, *others):
        # A row a record on both sides: what a task has of them is met there, never gathered on the driver, however small the files are.
        met = met.join(told.hint("shuffle_hash"), "record_num", "left")
    # What meets is written once: the many expressions that follow are planned for one stage, not again after every shuffle.
    out = settled(stored(met, "bib-parts"), rules)
    if required is None:
        return out, out.where("false").select("record_num")
    return out.where(F.col(required).isNotNull()), out.where(F.col(required).isNull()).select("record_num")
