"""Subject and genre headings: an ordered fold over each field's subfields, facets of their terms, and lists per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.arrays import combine_phrases, subfield_array

#: Tags of subject and genre fields; those of main terms that are no topics; of names and titles (fixed values).
SUBJECT_TAGS = ("380", "600", "610", "611", "630", "647", "648", "650", "651", "653", "655", "656", "657", "690", "691", "692", "696", "697", "698", "699")
GENRE_TAGS, REGION_TAGS, ERA_TAGS, NAME_TAGS = ("380", "655"), ("651", "691"), ("648",), ("600", "610", "611", "630")
#: Kinds of subdivisions by subfield (fixed values).
SUBDIVISIONS = {"v": "genre", "x": "topic", "y": "era", "z": "region"}
BETWEEN = " > "
_STRINGS = "array<string>"
_TERM = "struct<heading:string,kind:string,term:string,parents:array<string>>"


def _main_codes(tag: Column) -> Column:
    """Subfields of a main term; of a name with a title, both together, in their order."""
    plain = F.array(*map(F.lit, "abcdg"))
    return F.when(tag.isin(*GENRE_TAGS), F.array(*map(F.lit, "ab"))).when(tag.isin(*NAME_TAGS), F.array(*map(F.lit, "abcdfgklmnopqrt"))).otherwise(plain)


def subject_terms(fields: DataFrame) -> DataFrame:
    """Fields with ``terms``: (heading, kind, term, parents) of the main term and each subdivision in order.

    ``fields`` has marc_tag and content.  A heading is what the field's terms
    so far come to, parents are the terms before this one.  The main term's
    kind is told by its tag, those of subdivisions (``v x y z``) by subfield;
    other subfields are no terms.  Marks around terms go; what has nothing left
    is left out.
    """
    tag = F.col("marc_tag")
    out = fields.withColumn("_subs", subfield_array(F.col("content")))
    subs = F.col("_subs")
    main = K.strip_ends(F.array_join(F.transform(F.filter(subs, lambda s: F.array_contains(_main_codes(tag), s["code"])), lambda s: s["value"]), " "))
    kind = F.when(tag.isin(*GENRE_TAGS), "genre").when(tag.isin(*REGION_TAGS), "region").when(tag.isin(*ERA_TAGS), "era").otherwise("topic")
    none = F.array().cast(_STRINGS)
    first = F.when(F.col("_main") != "", F.array(F.struct(F.col("_main").alias("heading"), kind.alias("kind"), F.col("_main").alias("term"), none.alias("parents")))).otherwise(F.array().cast(f"array<{_TERM}>"))
    below = F.transform(F.filter(subs, lambda s: s["code"].isin(*SUBDIVISIONS)), lambda s: F.struct(F.create_map(*[F.lit(x) for kv in SUBDIVISIONS.items() for x in kv])[s["code"]].alias("kind"), K.strip_ends(s["value"]).alias("term")))

    def fold(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        term = F.struct(
            F.concat_ws(BETWEEN, last["heading"], s["term"]).alias("heading"),
            s["kind"].alias("kind"),
            s["term"].alias("term"),
            F.coalesce(F.array_append(last["parents"], last["term"]), none).alias("parents"),
        )
        return F.concat(acc, F.array(term))

    out = out.withColumn("_main", F.coalesce(main, F.lit(""))).withColumn("_below", F.filter(F.coalesce(below, F.array().cast("array<struct<kind:string,term:string>>")), lambda s: s["term"] != ""))
    return out.withColumn("terms", F.aggregate("_below", first, fold)).drop("_subs", "_main", "_below")


def subject_headings(varfields: DataFrame, tags: Sequence[str] = SUBJECT_TAGS) -> DataFrame:
    """(record_num, heading, kind, term, parents): every heading built up term by term with the kind of its last term; each once per record, by the first field that has it."""
    terms = subject_terms(varfields.where(F.col("marc_tag").isin(*tags))).select("record_num", "marc_tag", "occ_num", F.posexplode("terms").alias("_place", "_t"))
    first = terms.groupBy("record_num", F.col("_t.heading").alias("heading")).agg(F.min_by("_t", F.struct("marc_tag", "occ_num", "_place")).alias("_t"))
    return first.select("record_num", "heading", "_t.kind", "_t.term", "_t.parents")


def mapped_facets(terms: DataFrame, mapping: DataFrame, patterns: Sequence[tuple[str, Sequence[tuple[str, str]]]] = (), term: str = "term", kind: str = "kind", parents: str = "parents") -> DataFrame:
    """``terms`` with ``facets``, the (kind, term) pairs that a subdivision stands for.

    ``mapping`` is (key, parent, facets): keys and parents in lower case, of
    letters, digits and blanks alone.  The entry of the first of the term's
    ``parents`` that has one goes before the entry without a parent; mapped
    terms are of the term's own kind, those of an era are topics and the era
    stays.  Without an entry the first pattern that is found (in any case)
    gives its (kind, term) pairs; ``{}`` stands for its group, whose leading
    small letters go, or which is capitalised if it has small ones alone.
    Without any the term stands for itself.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N} ]", ""))
    # one row per key: what it stands for below each parent
    by_key = mapping.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("parent", F.lit("")).alias("parent"), "facets"))).alias("_by_parent"))
    met = terms.withColumn("_key", plain(F.col(term))).join(by_key.withColumnRenamed("key", "_key"), "_key", "left")
    above = F.array_append(F.transform(F.coalesce(F.col(parents), F.array().cast(_STRINGS)), plain), F.lit(""))
    met = met.withColumn("_facets", F.when(F.col("_by_parent").isNotNull(), F.try_element_at(F.filter(F.transform(above, lambda p: F.try_element_at(F.col("_by_parent"), p)), lambda f: f.isNotNull()), F.lit(1))))
    pair = lambda k, t: F.struct(k.alias("kind"), t.alias("term"))
    own, era = F.col(kind), F.col(kind) == "era"
    mapped = F.concat(F.transform("_facets", lambda t: pair(F.when(era, "topic").otherwise(own), t)), F.when(era, F.array(pair(own, F.col(term)))).otherwise(F.array().cast("array<struct<kind:string,term:string>>")))
    capital = lambda t: F.when(t.rlike("[A-Z]"), F.regexp_replace(t, "^[^A-Z]+", "")).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30))))
    by_pattern = None
    for pattern, new in patterns:
        hit = F.col(term).rlike(f"(?i){pattern}")
        group = F.regexp_extract(term, f"(?i){pattern}", 1) if any("{}" in t for _, t in new) else F.lit("")
        filled = lambda t, g=group: F.lit(t) if "{}" not in t else K.let(F.concat(*[x for i, w in enumerate(t.split("{}")) for x in ([g] if i else []) + [F.lit(w)]]), capital)
        made = F.array(*[pair(F.lit(k), filled(t)) for k, t in new])
        by_pattern = F.when(hit, made) if by_pattern is None else by_pattern.when(hit, made)
    choices = [mapped, *([by_pattern] if by_pattern is not None else []), F.array(pair(own, F.col(term)))]
    return met.withColumn("facets", F.coalesce(*choices)).drop("_key", "_by_parent", "_facets")


def map_subdivisions(terms: DataFrame, mapping: DataFrame, patterns: Sequence[tuple[str, Sequence[tuple[str, str]]]] = (), term: str = "term", kind: str = "kind", parents: str = "parents") -> DataFrame:
    """``mapped_facets`` as one row per (facet_kind, facet_term)."""
    out = mapped_facets(terms, mapping, patterns, term, kind, parents).withColumn("_f", F.explode("facets"))
    return out.withColumns({"facet_kind": F.col("_f.kind"), "facet_term": F.col("_f.term")}).drop("facets", "_f")


def heading_rows(fields: DataFrame, mapping: DataFrame, patterns: Sequence[tuple[str, Sequence[tuple[str, str]]]] = ()) -> DataFrame:
    """One row per term of subject fields (record_num, marc_tag, occ_num, content): (…, place, n_terms, genre, heading, term, facets), subdivisions with their mapped facets, and the keys of all.

    Uncontrolled terms (653) and those for search alone (692) have no facets;
    a topic below a genre is a genre of its own, behind the main one.
    """
    plain = F.col("marc_tag").isin("653", "692")
    rows = subject_terms(fields).select("record_num", "marc_tag", "occ_num", F.size("terms").alias("n_terms"), F.element_at("terms", 1)["term"].alias("_main"), F.posexplode("terms").alias("place", "_t"))
    rows = rows.select("*", "_t.*").drop("_t").withColumn("genre", F.col("marc_tag").isin(*GENRE_TAGS))
    own = F.struct("kind", "term")
    below = mapped_facets(rows, mapping, patterns)
    specific = F.col("genre") & (F.col("kind") == "topic")
    narrower = F.struct(F.lit("genre").alias("kind"), F.concat_ws(", ", F.col("_main"), F.col("term")).alias("term"))
    facets = F.when(F.col("place") == 0, F.array(own)).when(specific, F.concat(F.filter("facets", lambda f: ~((f["kind"] == "topic") & (f["term"] == F.col("term")))), F.array(narrower))).otherwise(F.col("facets"))
    keyed = F.transform(F.col("_facets"), lambda f: F.struct(f["kind"].alias("kind"), f["term"].alias("term"), K.facet_key(f["term"]).alias("key")))
    out = below.withColumn("_facets", facets).withColumn("facets", keyed).withColumn("key", K.facet_key(F.col("heading"))).withColumn("term_key", K.facet_key(F.col("term")))
    return out.withColumn("faceted", ~plain).drop("_main", "_facets", "parents")


#: The columns of a record that its headings fill.
FACETS = ("topic", "era", "region", "genre")


def heading_columns(rows: Column) -> dict[str, Column]:
    """The columns that a record's headings fill, from its rows of ``heading_rows`` in order.

    ``*_search_all_terms`` have no phrase that stands within another.  Lists
    keep their order; null where empty.
    """
    values = lambda test, value: F.transform(F.filter(rows, test), value)
    whole = lambda r: r["place"] == r["n_terms"] - 1
    shown = lambda key, name: F.concat_ws("!", key, name)
    facet = lambda kind: F.flatten(values(lambda r: r["faceted"], lambda r: F.transform(F.filter(r["facets"], lambda f: f["kind"] == kind), lambda f: shown(f["key"], f["term"]))))
    pair = lambda term, key: F.struct(term.alias("term"), key.alias("key"))
    names = lambda pairs: F.transform(pairs, lambda x: x["term"])
    found: dict[str, Column] = {}

    def of_side(name: str, genres: bool) -> None:
        """Columns of subject fields or of genre fields; genre subdivisions of subjects are searched as genres."""
        here = lambda r: r["genre"] == F.lit(genres)
        found[f"{name}_headings_display"] = values(lambda r: here(r) & whole(r) & (r["marc_tag"] != "692"), lambda r: r["heading"])
        found[f"{name}_heading_facet"] = F.array_distinct(values(lambda r: here(r) & r["faceted"], lambda r: shown(r["key"], r["heading"])))
        found[f"{name}s_search_exact_headings"] = values(lambda r: here(r) & whole(r), lambda r: r["heading"])
        mains = F.array_distinct(values(lambda r: here(r) & (r["place"] == 0) & (r["marc_tag"] != "653"), lambda r: pair(r["term"], r["term_key"])))
        meant = lambda r: F.array_append(r["facets"], F.struct(r["kind"].alias("kind"), r["term"].alias("term"), r["term_key"].alias("key")))
        below = F.filter(rows, lambda r: (r["place"] > 0) | (r["marc_tag"] == "653"))
        second = F.flatten(F.transform(below, lambda r: F.transform(F.filter(meant(r), lambda f: (r["genre"] | (f["kind"] == "genre")) == F.lit(genres)), lambda f: pair(f["term"], f["key"]))))
        found[f"{name}s_search_main_terms"] = names(mains)
        both = F.struct(mains.alias("m"), F.array_distinct(second).alias("s"))
        found[f"{name}s_search_all_terms"] = F.array_distinct(names(K.let(both, lambda x: combine_phrases(x["m"], x["s"], lambda p: p["key"]))))

    of_side("subject", False)
    of_side("genre", True)
    for kind in FACETS:
        found[f"{kind}_facet"] = F.array_distinct(facet(kind))
    return {n: K.let(c, lambda a: F.when(F.size(a) > 0, a)) for n, c in found.items()}


#: Columns of ``heading_rows`` in the order in which a record's rows stand.
ROW = ("marc_tag", "occ_num", "place", "n_terms", "genre", "heading", "kind", "term", "facets", "key", "term_key", "faceted")


def first_fields(rows: Column) -> Column:
    """Rows without those of fields whose whole heading an earlier one of the record has (genres apart from subjects)."""
    own = lambda r: F.struct(r["marc_tag"].alias("t"), r["occ_num"].alias("o"))
    last = F.filter(rows, lambda r: r["place"] == r["n_terms"] - 1)
    whole = F.transform(last, lambda r: F.struct(r["genre"].alias("g"), r["heading"].alias("h")))
    firsts = F.filter(F.transform(last, lambda r, i: F.when(F.array_position(whole, F.get(whole, i)) == i + 1, own(r))), lambda f: f.isNotNull())
    return F.filter(rows, lambda r: F.array_contains(firsts, own(r)))


def record_headings(varfields: DataFrame, mapping: DataFrame, patterns: Sequence[tuple[str, Sequence[tuple[str, str]]]] = (), tags: Sequence[str] = SUBJECT_TAGS) -> DataFrame:
    """(record_num, columns of ``heading_columns``) of records with subject or genre fields.

    A field whose whole heading an earlier one of the record has (genres apart
    from subjects) tells nothing more.
    """
    rows = heading_rows(varfields.where(F.col("marc_tag").isin(*tags)), mapping, patterns)
    listed = rows.groupBy("record_num").agg(F.array_sort(F.collect_list(F.struct(*ROW))).alias("_rows"))
    listed = listed.withColumn("_rows", first_fields(F.col("_rows")))
    return listed.select("record_num", *[c.alias(n) for n, c in heading_columns(F.col("_rows")).items()])
