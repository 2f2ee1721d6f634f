"""Queries for numbers, headings and whole documents of records.

Fields of many forms are made from the columns of ``part``; what each comes to
is told in SQL by its own form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import project as J
from ..operators import bibs as B
from ..operators import documents as D
from ..operators import identifiers as I
from ..operators import rules as U
from ..operators import subjects as S
from .document_queries import PICTURES
from .registry import Registry

reg = Registry()
add = reg.add

Form = tuple[Sequence[tuple[str, str, str]], Mapping[str, str]]


def fields_of(forms: Sequence[Form]) -> str:
    """SQL of the fields (tag, first indicator, content) of each form, one form per remainder of the key."""
    rows = [(i, n, f) for i, (fields, _) in enumerate(forms) for n, f in enumerate(fields)]
    return " UNION ALL ".join(f"SELECT p_partkey AS record_num, CAST('f' AS VARCHAR(1)) AS type_code, '{tag}' AS marc_tag, '{ind1}' AS ind1, '' AS ind2, {n} AS occ_num, {content} AS content FROM {{part}} WHERE p_partkey % {len(forms)} = {i}" for i, n, (tag, ind1, content) in rows)


def said_of(forms: Sequence[Form], columns: Sequence[str]) -> str:
    """SQL of what the forms come to; columns that a form does not tell are empty."""
    told = [" ".join([f"CASE p_partkey % {len(forms)}", *(f"WHEN {i} THEN {said.get(c, chr(39) * 2)}" for i, (_, said) in enumerate(forms)), f"END AS {c}"]) for c in columns]
    return f"SELECT p_partkey AS record_num, {', '.join(told)} FROM part"


def joined(*columns: str) -> list:
    return [F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "|").alias(c) for c in columns]


_N = "(100000000 + p_partkey)"
_STANDARD: tuple[Form, ...] = (
    ((("020", " ", f"'|a0-' || {_N} || '-X (' || p_type || ' ; pbk.) :|c12.50|z' || p_partkey"),), {"isbn_numbers": f"'0' || {_N} || 'X'", "isbns_display": f"'0' || {_N} || 'X (' || p_type || ', pbk., 12.50)|' || p_partkey || ' (' || p_type || ', pbk., 12.50) [Invalid]'", "all_standard_numbers": f"'0' || {_N} || 'X|' || p_partkey"}),
    ((("022", " ", "'|a' || p_partkey || '-123X|l' || p_partkey || '-0001|y9-9'"), ("022", " ", "'|a' || p_partkey || '-123X|m8-8|z7-7'")), {"issn_numbers": "p_partkey || '-123X|' || p_partkey || '-0001'", "issns_display": "p_partkey || '-123X|ISSN-L: ' || p_partkey || '-0001|9-9 [Incorrect]|' || p_partkey || '-123X|ISSN-L: 8-8 [Canceled]|7-7 [Canceled]'", "all_standard_numbers": "p_partkey || '-123X|' || p_partkey || '-0001|9-9|' || p_partkey || '-123X|8-8|7-7'"}),
    ((("024", "3", f"'|a' || {_N} || '|d' || p_size || '|qscore'"), ("024", "7", "'|a10.1/' || p_partkey || '|2doi'")), {"other_standard_numbers_display": f"'International Article Number: ' || {_N} || ' ' || p_size || ' (score)|10.1/' || p_partkey || ' (source: doi)'", "all_standard_numbers": f"{_N} || ' ' || p_size || '|10.1/' || p_partkey"}),
    ((("028", "0", "'|aLSC ' || p_partkey || '|b' || p_brand"), ("028", "6", "'|aDV' || p_size")), {"other_standard_numbers_display": "'Publisher Number, ' || p_brand || ': LSC ' || p_partkey || '|Distributor Number: DV' || p_size", "all_standard_numbers": "'LSC ' || p_partkey || '|DV' || p_size"}),
    ((("030", " ", "'|aJP' || p_partkey || 'A|zJP' || p_partkey || 'B'"), ("088", " ", "'|aNASA-RP-' || p_partkey")), {"other_standard_numbers_display": "'CODEN: JP' || p_partkey || 'A|CODEN: JP' || p_partkey || 'B [Invalid]|Report Number: NASA-RP-' || p_partkey", "all_standard_numbers": "'JP' || p_partkey || 'A|JP' || p_partkey || 'B|NASA-RP-' || p_partkey"}),
    ((("026", " ", "'|adete ' || p_size || '|b' || p_brand || '|2fei|5UkCU'"), ("020", " ", "'|ano number|qpaper'")), {"other_standard_numbers_display": "'Fingerprint ID: dete ' || p_size || ' ' || p_brand", "all_standard_numbers": "'dete ' || p_size || ' ' || p_brand"}),
)
_STANDARD_COLUMNS = ("isbn_numbers", "issn_numbers", "isbns_display", "issns_display", "other_standard_numbers_display", "all_standard_numbers")
add("D17_standard_numbers", lambda c: I.standard_numbers(c._spark.sql(fields_of(_STANDARD), part=c.part)).select("record_num", *joined(*_STANDARD_COLUMNS)), said_of(_STANDARD, _STANDARD_COLUMNS))

_LATER = "(p_partkey + 1000007)"
_CONTROL: tuple[Form, ...] = (
    ((("001", "", "'ocm000' || (p_partkey + 7)"), ("035", " ", f"'|a(OCoLC)' || {_LATER}")), {"oclc_numbers": f"CAST({_LATER} AS VARCHAR)", "oclc_numbers_display": f"{_LATER} || '|' || (p_partkey + 7) || ' [Invalid]'", "all_control_numbers": f"{_LATER} || '|' || (p_partkey + 7)", "control_numbers_search": f"{_LATER} || '|' || (p_partkey + 7)"}),
    ((("001", "", "'on0' || (p_partkey + 7)"), ("010", " ", "'|a   85-' || (p_partkey + 7) || ' /AC'")), {"lccn_number": "'85' || lpad(CAST((p_partkey + 7) AS VARCHAR), 6, '0')", "lccns_display": "'85-' || (p_partkey + 7) || ' /AC (i.e., 85' || lpad(CAST((p_partkey + 7) AS VARCHAR), 6, '0') || ')'", "oclc_numbers": "CAST((p_partkey + 7) AS VARCHAR)", "oclc_numbers_display": "CAST((p_partkey + 7) AS VARCHAR)", "all_control_numbers": "(p_partkey + 7) || '|85' || lpad(CAST((p_partkey + 7) AS VARCHAR), 6, '0') || '|85-' || (p_partkey + 7) || ' /AC'", "control_numbers_search": "'85' || lpad(CAST((p_partkey + 7) AS VARCHAR), 6, '0') || '|85-' || (p_partkey + 7) || ' /AC|' || (p_partkey + 7)"}),
    ((("001", "", "CAST((p_partkey + 7) AS VARCHAR(9))"), ("035", " ", f"'|z(OCoLC)on' || {_LATER}")), {"oclc_numbers": "CAST((p_partkey + 7) AS VARCHAR)", "oclc_numbers_display": f"(p_partkey + 7) || '|' || {_LATER} || ' [Invalid]'", "all_control_numbers": f"(p_partkey + 7) || '|' || {_LATER}", "control_numbers_search": f"{_LATER} || '|' || (p_partkey + 7)"}),
    ((("001", "", "'ybp' || (p_partkey + 7)"), ("035", " ", "'|a(OCoLC)ocn' || (p_partkey + 7)"), ("035", " ", "'|a(YBP)y' || p_size")), {"oclc_numbers": "CAST((p_partkey + 7) AS VARCHAR)", "oclc_numbers_display": "CAST((p_partkey + 7) AS VARCHAR)", "other_control_numbers_display": "'y' || p_size || ' (source: YBP)|[Unknown Type]: ybp' || (p_partkey + 7)", "all_control_numbers": "(p_partkey + 7) || '|y' || p_size || '|ybp' || (p_partkey + 7)", "control_numbers_search": "(p_partkey + 7) || '|y' || p_size || '|ybp' || (p_partkey + 7)"}),
    ((("001", "", "(p_partkey + 7) || '/ab'"), ("035", " ", "'|a(OCoLC)on0' || (p_partkey + 7)"), ("016", "7", "'|a9.' || p_size || '|2GyF'")), {"oclc_numbers": "CAST((p_partkey + 7) AS VARCHAR)", "oclc_numbers_display": "CAST((p_partkey + 7) AS VARCHAR)", "other_control_numbers_display": "'9.' || p_size || ' (source: GyF)'", "all_control_numbers": "'9.' || p_size || '|' || (p_partkey + 7)", "control_numbers_search": "'9.' || p_size || '|' || (p_partkey + 7) || '|' || (p_partkey + 7) || '/ab'"}),
)
_CONTROL_COLUMNS = ("oclc_numbers", "lccns_display", "oclc_numbers_display", "other_control_numbers_display", "all_control_numbers", "control_numbers_search")
add("D18_control_numbers", lambda c: I.control_numbers(c._spark.sql(fields_of(_CONTROL), part=c.part)).select("record_num", F.coalesce("lccn_number", F.lit("")).alias("lccn_number"), *joined(*_CONTROL_COLUMNS)), said_of(_CONTROL, ("lccn_number", *_CONTROL_COLUMNS)))

#: Fields with their terms: (heading, kind, term, parents), the last three by what the field is made of.
_YEAR = "'199' || p_size % 5"
_HEADED: tuple[Form, ...] = (
    ((("650", " ", f"'|aArt ' || p_size || ',|bold.|2fast|0(x)1|x' || p_brand || '.|y' || {_YEAR} || '|4aut'"),), {"terms": f"[['Art ' || p_size || ', old', 'topic', ''], [p_brand, 'topic', 'Art ' || p_size || ', old'], [{_YEAR}, 'era', 'Art ' || p_size || ', old^' || p_brand]]"}),
    ((("651", " ", "'|a' || p_type || '|xEconomy|zTexas ;|vMaps, etc.'"), ("651", " ", "'|a' || p_type || '.|xEconomy'")), {"terms": "[[p_type, 'region', ''], ['Economy', 'topic', p_type], ['Texas', 'region', p_type || '^Economy'], ['Maps, etc.', 'genre', p_type || '^Economy^Texas']]"}),
    ((("655", "7", "'|aNovels.|2gsafd'"), ("648", " ", "'|a19' || p_size % 9 || '0-1999'"), ("650", " ", "'|2fast'")), {"terms": "[['Novels', 'genre', ''], ['19' || p_size % 9 || '0-1999', 'era', '']]"}),
)
_TERMS = f"""SELECT p_partkey AS record_num, t[1] AS term, t[2] AS kind, t[3] AS parents, CASE WHEN t[3] = '' THEN t[1] ELSE replace(t[3], '^', ' > ') || ' > ' || t[1] END AS heading
FROM (SELECT p_partkey, p_brand, unnest(CASE p_partkey % {len(_HEADED)} {' '.join(f"WHEN {i} THEN {said['terms']}" for i, (_, said) in enumerate(_HEADED))} END) AS t FROM part)"""


def _headings(c):
    return S.subject_headings(c._spark.sql(fields_of(_HEADED), part=c.part))


add("D20_subject_headings", lambda c: _headings(c).select("record_num", "heading", "kind", "term", F.array_join("parents", "^").alias("parents")), f"SELECT record_num, heading, kind, term, parents FROM ({_TERMS})")
_MAPPING = [("economy", None, ["Cheap things", "Goods"]), ("1993", "brand13", ["Nineties of 13"]), ("1993", None, ["Year 93"]), ("1994", "no such", ["Wrong"]), ("texas", "economy", ["Texas, economy of"])]
_PATTERNS = [("^199([0-4])$", [("era", "199{} early")]), ("^(br?and)#", [("topic", "Brands"), ("form", "{}")])]


def _mapping(c):
    return c._spark.createDataFrame(_MAPPING, "key string, parent string, facets array<string>")


add("D21_map_subdivisions", lambda c: S.map_subdivisions(_headings(c).where(F.size("parents") > 0), _mapping(c), _PATTERNS).select("record_num", "heading", "facet_kind", "facet_term"), f"""
WITH t AS ({_TERMS})
SELECT record_num, heading, f.k AS facet_kind, f.t AS facet_term FROM (SELECT record_num, heading, unnest(CASE
  WHEN term = 'Economy' THEN [{{'k': kind, 't': 'Cheap things'}}, {{'k': kind, 't': 'Goods'}}]
  WHEN term = 'Texas' THEN [{{'k': kind, 't': 'Texas, economy of'}}]
  WHEN term = '1993' THEN [{{'k': 'topic', 't': CASE WHEN suffix(parents, '^Brand#13') THEN 'Nineties of 13' ELSE 'Year 93' END}}, {{'k': 'era', 't': term}}]
  WHEN term IN ('1990', '1991', '1992', '1994') THEN [{{'k': 'era', 't': term || ' early'}}]
  WHEN term LIKE 'Brand#%' THEN [{{'k': 'topic', 't': 'Brands'}}, {{'k': 'form', 't': 'Brand'}}]
  ELSE [{{'k': kind, 't': term}}] END) AS f FROM t WHERE parents <> '')""")

_PUT = "CASE WHEN {6} THEN named_struct('type_code', '{0}', 'marc_tag', '{1}', 'ind1', '{2}', 'ind2', '{3}', 'occ_num', {4}, 'content', {5}) END"
_F008 = "'240101r' || (1900 + k % 100) || '    xx            000 0 ' || 'eng d'"
_BIB_FIELDS = "SELECT k AS record_num, f.* FROM (SELECT k, explode(array({})) AS f FROM {{p}}) WHERE f IS NOT NULL".format(
    ", ".join(
    _PUT.format(*row)
    for row in (
        ("c", "050", "", "", 0, "'|aQA' || k || '|b.A1'", "true"),
        ("c", "086", "", "", 0, "'|aY ' || k || '.2:'", "true"),
        ("o", "001", "", "", 0, "'ocm000' || (1000 + k)", "true"),
        ("o", "035", "", "", 1, "'|a(OCoLC)' || (2000 + k)", "k % 2 = 0"),
        ("y", "008", "", "", 0, _F008, "true"),
        ("y", "007", "", "", 0, "'ta '", "k % 3 = 0"),
        ("i", "020", "", "", 0, "'|a' || (9000000 + k) || ' (pbk.)|z' || (8000000 + k)", "k % 3 > 0"),
        ("i", "028", "0", "", 0, "'|aLSC ' || k || '|bDecca'", "k % 5 = 0"),
        ("p", "264", "", "1", 0, "'|aCity :|b' || brand || ',|c' || (1900 + k % 100) || '.'", "true"),
        ("p", "260", "", "", 0, "'|aTown|bPress|c1950, c1949|eYork :|fMill'", "k % 4 = 1"),
        ("d", "650", "", "0", 0, "'|a' || kind || '|xEconomy|y1993|2fast|0(x)1'", "true"),
        ("d", "651", "", "0", 1, "'|aTexas|vMaps.'", "k % 2 = 1"),
        ("d", "655", "", "7", 2, "'|aNovels.|2gsafd'", "k % 3 = 1"),
        ("n", "505", "", "", 0, "'|aContents ' || k", "true"),
        ("n", "500", "", "", 1, "'|aNote ' || k", "true"),
        ("n", "592", "", "", 2, "'|aa5t10;p2'", "k % 7 = 0"),
        ("n", "546", "", "", 3, "'|aIn two tongues'", "k % 9 = 0"),
        ("l", "041", "", "", 0, "'|afreeng|hger'", "k % 2 = 0"),
        ("e", "250", "", "", 0, "'|a2nd ed.'", "k % 4 = 0"),
        ("h", "866", "", "", 0, "'|av.1-' || k", "k % 4 = 2"),
        ("u", "856", "4", "0", 0, "'|uhttp://pictures.example/ark:/6/' || k || '/?q=1|zFull text'", "k % 6 = 0"),
        ("u", "856", "4", "2", 1, "'|uhttp://book.example/' || k || '|yReview'", "k % 6 < 2"),
    )
    )
)
_RULES = B.BibRules(
    call_numbers=[("c", "099", "other"), ("c", "050", "lc")],
    booking_host="book.example",
    picture_hosts=PICTURES,
    local_host="library.example",
    reserve_url="https://catalogue.example/",
    languages={"eng": "English", "fre": "French", "ger": "German"},
    subdivision_patterns=_PATTERNS,
)
_BIB_LISTS = (
    "call_numbers_display", "call_numbers_search", "sudocs_display", "publication_display", "manufacture_display", "copyright_display", "publication_year_range_facet", "languages", "language_notes", "isbn_numbers", "isbns_display", "other_standard_numbers_display", "standard_numbers_search",
    "oclc_numbers", "oclc_numbers_display", "control_numbers_search", "subject_headings_display", "subject_heading_facet", "genre_headings_display", "topic_facet", "region_facet", "era_facet", "genre_facet", "toc_notes", "notes", "editions_display", "library_has_display",
    "urls_json", "games_ages_facet", "games_players_facet", "contributors", "meetings", "included_titles_facet", "series_titles_facet", "items_json", "access", "buildings", "collections", "resource_type_categories", "media_type_categories", "linked_series",
)
_BIB_ONE = ("call_number_type", "publication_dates_label", "thumbnail_url", "author", "author_sort", "resource_type")


#: Records whose fields, items and documents one task puts together.
TOGETHER = 5_000


def spread(records: DataFrame, key: str) -> DataFrame:
    """Records dealt out by key in as many tasks as they need: one small file would be one task, and a fixed number of tasks would hold more and more."""
    return records.repartition(max(16, -(-records.count() // TOGETHER)), key)


def _d27(c):
    p = c.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    p = spread(p, "k")
    fields = c._spark.sql(_BIB_FIELDS, p=p)
    k = F.col("k").alias("record_num")
    records = p.select(k, F.when(F.col("k") % 2 == 0, "-").otherwise("m").alias("level"), F.lit(False).alias("serial"), F.lit("a").alias("bcode2"), F.lit("2020-01-01").alias("created"), F.lit("2021-01-01").alias("catalogued"))
    # items: two each at the stacks, one online for some
    place = F.when(F.col("k") % 7 == 0, "czmgames").otherwise("w3")
    item = lambda n, number, at: F.struct(F.concat(F.lit("i"), "k", F.lit(f"-{n}")).alias("item_id"), number.cast("string").alias("call_number"), at.alias("location_code"), F.lit(9 - n).alias("display_order"), F.lit(n == 3).alias("suppressed"))
    web = item(4, F.lit(None), F.lit("lwww"))
    each = F.array(item(1, F.concat(F.lit("QA"), "k", F.lit(" .A1")), place), item(2, F.concat(F.lit("QB"), "k"), place), item(3, F.lit("hidden"), place), F.when(F.col("k") % 12 == 6, web))
    items = p.select(k, F.when(F.col("k") % 8 == 0, "sudoc").otherwise("lc").alias("call_number_type"), F.lit(None).cast("string").alias("volume"), F.lit(1).alias("copy_number"), F.explode(F.filter(each, lambda i: i.isNotNull())).alias("i")).select("*", "i.*").drop("i")
    places = U.location_places(c._spark.createDataFrame([("w", "Main"), ("w3", "Third floor"), ("czm", "Media"), ("czmgames", "Games"), ("lwww", "Web")], "location_code string, label string"))
    members = c._spark.createDataFrame([("Books", "w3"), ("Games", "czmgames")], "collection string, location_code string")
    name = lambda heading, tag, position, combined=False: F.struct(heading.alias("heading"), F.lit(tag).alias("tag"), F.lit(position).alias("position"), F.lit(combined).alias("combined"))
    each = F.array(name(F.concat(F.lit("Doe "), F.col("k") % 7), "100", 0), name(F.lit("Roe"), "700", 1), name(F.lit("Comb"), "710", 2, True), name(F.lit("Meeting"), "711", 3))
    names = p.where("k % 10 < 9").select(k, F.explode(each).alias("n")).select("record_num", "n.*")
    title = lambda text, kind, position: F.struct(text.alias("title"), F.lit(kind).alias("kind"), F.lit(position).alias("position"))
    titles = p.select(k, F.explode(F.array(title(F.concat(F.lit("Title "), "k"), "included", 0), title(F.concat(F.lit("Series "), F.col("k") % 5), "series", 1))).alias("t")).select("record_num", "t.*")
    works = D.title_facets(titles, "record_num", "title", "kind", "position", "related")
    shown = works.groupBy("record_num").agg(*[D.ordered_list(F.col("work_key"), F.when(F.col("kind") == x, F.concat_ws("!", "work_key", "title"))).alias(f"{x}_titles_facet") for x in ("included", "series")])
    links = p.select(k, F.concat(F.lit("Series "), F.col("k") % 3).alias("title"), F.lit("series").alias("kind"), F.lit(0).alias("position"))
    linked = D.linked_works(links, works, "record_num", "title", "kind", "position", ("series",)).groupBy("record_num").agg(D.ordered_list(F.col("work_key"), "title").alias("linked_series"))
    people = D.author_facets(names, "record_num", "heading", "tag", "position")
    at = items.select("record_num", "location_code")
    access = U.access_facets(records.select("record_num"), items, at, places, members, "record_num")
    added = J.date_added(records.select("record_num", "created", "catalogued"), at, "record_num", "created", "catalogued").select("record_num", "date_added")
    others = [people, shown, linked, access, added, D.item_json(items, "record_num")]
    good, bad = B.bib_documents(records, fields, items, _mapping(c), _RULES, others, "author")
    lists = [F.array_join(F.transform(F.coalesce(x, F.array()), lambda v: v.cast("string")), "^").alias(x) for x in _BIB_LISTS]
    told = good.select("record_num", *_BIB_ONE, "date_added", "record_boost", "has_more_items", *lists)
    return told.unionByName(bad.withColumn("author", F.lit("failed")), allowMissingColumns=True)


_TYPE_KEY = "trim(regexp_replace(lower(p_type), '[^a-z0-9_]+', '-', 'g'), '-')"
_JSON = """'{"i":"i' || k || '-' || n || '","c":"' || CASE WHEN n = 1 THEN 'QA' || k || ' .A1' WHEN n = 2 THEN 'QB' || k ELSE 'hidden' END || '","l":"' || loc || '"}'"""
add("D27_bib_documents", _d27, f"""
WITH p AS (SELECT *, p_partkey AS k, 1900 + p_partkey % 100 AS y, CASE WHEN p_partkey % 7 = 0 THEN 'czmgames' ELSE 'w3' END AS loc, p_partkey % 12 = 6 AS web FROM part WHERE p_partkey % 10 < 9),
j AS (SELECT k, string_agg({_JSON}, '^' ORDER BY n DESC) AS js FROM p, (SELECT unnest([1, 2, 3]) AS n) WHERE NOT (web AND n = 1) GROUP BY 1),
q AS (SELECT *, list_distinct(list_concat([y], CASE WHEN k % 4 = 1 THEN [1949, 1950] ELSE [] END)) AS ys FROM p)
SELECT k AS record_num, 'lc' AS call_number_type, CASE WHEN k % 8 = 0 THEN 'QA' || k || ' .A1' ELSE 'QA' || k || ' .A1^QB' || k END AS call_numbers_display,
  'QA^QA' || k || '^QA' || k || ' .A^QA' || k || ' .A1' || CASE WHEN k % 8 = 0 THEN '' ELSE '^QB^QB' || k END AS call_numbers_search, CASE WHEN k % 8 = 0 THEN 'QB' || k || '^QA' || k || ' .A1' ELSE '' END AS sudocs_display,
  CASE WHEN k % 4 = 1 THEN 'Town Press 1950^' ELSE '' END || 'City: ' || p_brand || ', ' || y || '.' AS publication_display, CASE WHEN k % 4 = 1 THEN 'York: Mill' ELSE '' END AS manufacture_display, CASE WHEN k % 4 = 1 THEN '©1949' ELSE '' END AS copyright_display,
  array_to_string(list_sort(ys), '^') AS publication_year_range_facet, CAST(y AS VARCHAR) AS publication_dates_label, CASE WHEN k % 2 = 0 THEN 'English^French^German' ELSE 'English' END AS languages,
  CASE WHEN k % 9 = 0 THEN 'In two tongues' WHEN k % 2 = 0 THEN 'Item language(s): English, French^Original language: German' ELSE 'Item language(s): English' END AS language_notes,
  CASE WHEN k % 3 > 0 THEN CAST(9000000 + k AS VARCHAR) ELSE '' END AS isbn_numbers, CASE WHEN k % 3 > 0 THEN (9000000 + k) || ' (pbk.)^' || (8000000 + k) || ' (pbk.) [Invalid]' ELSE '' END AS isbns_display,
  CASE WHEN k % 5 = 0 THEN 'Publisher Number, Decca: LSC ' || k ELSE '' END AS other_standard_numbers_display, concat_ws('^', CASE WHEN k % 3 > 0 THEN (9000000 + k) || '^' || (8000000 + k) END, CASE WHEN k % 5 = 0 THEN 'LSC ' || k END) AS standard_numbers_search,
  CAST(CASE WHEN k % 2 = 0 THEN 2000 + k ELSE 1000 + k END AS VARCHAR) AS oclc_numbers, CASE WHEN k % 2 = 0 THEN (2000 + k) || '^' || (1000 + k) || ' [Invalid]' ELSE CAST(1000 + k AS VARCHAR) END AS oclc_numbers_display, CASE WHEN k % 2 = 0 THEN (2000 + k) || '^' ELSE '' END || (1000 + k) AS control_numbers_search,
  p_type || ' > Economy > 1993' || CASE WHEN k % 2 = 1 THEN '^Texas > Maps' ELSE '' END AS subject_headings_display,
  {_TYPE_KEY} || '!' || p_type || '^' || {_TYPE_KEY} || '-economy!' || p_type || ' > Economy^' || {_TYPE_KEY} || '-economy-1993!' || p_type || ' > Economy > 1993' || CASE WHEN k % 2 = 1 THEN '^texas!Texas^texas-maps!Texas > Maps' ELSE '' END AS subject_heading_facet,
  CASE WHEN k % 3 = 1 THEN 'Novels' ELSE '' END AS genre_headings_display, {_TYPE_KEY} || '!' || p_type || '^cheap-things!Cheap things^goods!Goods^year-93!Year 93' AS topic_facet, CASE WHEN k % 2 = 1 THEN 'texas!Texas' ELSE '' END AS region_facet, '1993!1993' AS era_facet,
  concat_ws('^', CASE WHEN k % 2 = 1 THEN 'maps!Maps' END, CASE WHEN k % 3 = 1 THEN 'novels!Novels' END) AS genre_facet, 'Contents ' || k AS toc_notes, concat_ws('^', 'Note ' || k, CASE WHEN k % 7 = 0 THEN 'a5t10;p2' END) AS notes, CASE WHEN k % 4 = 0 THEN '2nd ed.' ELSE '' END AS editions_display, CASE WHEN k % 4 = 2 THEN 'v.1-' || k ELSE '' END AS library_has_display,
  concat_ws('^', CASE WHEN k % 6 = 0 THEN '{{"u":"http://pictures.example/ark:/6/' || k || '/?q=1","n":"Full text","t":"fulltext"}}' END, CASE WHEN k % 6 < 2 THEN '{{"u":"http://book.example/' || k || '","l":"Review","t":"booking"}}' END) AS urls_json, CASE WHEN k % 6 = 0 THEN 'https://pictures.example/ark:/6/' || k || '/small/' END AS thumbnail_url,
  CASE WHEN k % 7 = 0 THEN '005-010!5 to 10 years' ELSE '' END AS games_ages_facet, CASE WHEN k % 7 = 0 THEN '02-02!2 players' ELSE '' END AS games_players_facet,
  'Doe ' || k % 7 AS author, 'doe-' || k % 7 AS author_sort, 'roe!Roe' AS contributors, 'meeting!Meeting' AS meetings, 'title-' || k || '!Title ' || k AS included_titles_facet, 'series-' || k % 5 || '!Series ' || k % 5 AS series_titles_facet, CASE WHEN k % 3 = k % 5 THEN '' ELSE 'Series ' || k % 3 END AS linked_series,
  CASE WHEN web THEN '{{"i":"i' || k || '-4","l":"lwww"}}^' ELSE '' END || js AS items_json, web AS has_more_items, CASE WHEN web THEN 'At the Library^Online' ELSE 'At the Library' END AS access, CASE WHEN k % 7 = 0 THEN 'Media' ELSE 'Main' END AS buildings, CASE WHEN k % 7 = 0 THEN 'Games' ELSE 'Books' END AS collections,
  'book!Print/Paper' AS resource_type, 'books' AS resource_type_categories, 'Paper' AS media_type_categories, '2021-01-01' AS date_added, CAST(500 - (2020 - y) + CASE WHEN k % 2 = 0 THEN 500 ELSE 0 END AS INT) AS record_boost
FROM q JOIN j USING (k)
UNION ALL BY NAME SELECT p_partkey AS record_num, 'failed' AS author FROM part WHERE p_partkey % 10 = 9""")
