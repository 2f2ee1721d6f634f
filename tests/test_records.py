"""Golden rows of numbers, headings and whole documents of records."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import keys as K
from shelfwise.operators import identifiers as I
from shelfwise.operators import subjects as S

FIELDS = "record_num bigint, marc_tag string, ind1 string, occ_num int, content string"


def fields(spark, *given):
    """Fields of record 1 from (tag, first indicator, content)."""
    return spark.createDataFrame([(1, tag, ind1, i, content) for i, (tag, ind1, content) in enumerate(given)], FIELDS)


def told(df):
    """The columns of the only row that are not null."""
    rows = df.drop("record_num").collect()
    assert len(rows) == 1
    return {k: v for k, v in rows[0].asDict().items() if v is not None}


def standard(spark, *given):
    return told(I.standard_numbers(fields(spark, *given)))


def control(spark, *given):
    return told(I.control_numbers(fields(spark, *given)))


def only(name, shown, numbers):
    return {name: shown, "all_standard_numbers": numbers, "standard_numbers_search": numbers}


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (" : Art, modern. ", "Art, modern"),
        ("Smith, J.", "Smith, J."),
        ("Novels, etc.", "Novels, etc."),
        ("to be continued...", "to be continued..."),
        ("United States;,", "United States"),
        (".NET /", ".NET"),
        ("pts. ;", "pts."),
        (",;", ""),
        ("", ""),
    ],
)
def test_strip_ends(spark, given, want):
    assert spark.createDataFrame([(given,)], "c string").select(K.strip_ends(F.col("c"))).first()[0] == want


def test_isbn(spark):
    got = standard(spark, ("020", " ", "|a0-19-852663-6 (Oxford ; pbk.) :|c12.50|z0198526631"))
    assert got == {
        "isbns_display": ["0198526636 (Oxford, pbk., 12.50)", "0198526631 (Oxford, pbk., 12.50) [Invalid]"],
        "isbn_numbers": ["0198526636"],
        "all_standard_numbers": ["0198526636", "0198526631"],
        "standard_numbers_search": ["0198526636", "0198526631"],
    }
    assert standard(spark, ("020", " ", "|z978019852663X|q(cloth ;|qalk. paper)"))["isbns_display"] == ["978019852663X (cloth, alk. paper) [Invalid]"]
    # the same number twice is a number once, but shown twice; no digits, no number
    got = standard(spark, ("020", " ", "|a0198526636"), ("020", " ", "|anone given"), ("020", " ", "|a0198526636"))
    assert got["isbn_numbers"] == ["0198526636"] and got["isbns_display"] == ["0198526636"] * 2


def test_issn(spark):
    got = standard(spark, ("022", " ", "|a2049-3630|l0317-8471|m1050-124X|y2049-3631|z0000-0019"))
    assert got["issns_display"] == ["2049-3630", "ISSN-L: 0317-8471", "ISSN-L: 1050-124X [Canceled]", "2049-3631 [Incorrect]", "0000-0019 [Canceled]"]
    assert got["issn_numbers"] == ["2049-3630", "0317-8471"]
    assert got["all_standard_numbers"] == ["2049-3630", "0317-8471", "1050-124X", "2049-3631", "0000-0019"]


@pytest.mark.parametrize(
    ("field", "shown", "numbers"),
    [
        (("024", "0", "|aUSRC17607839"), ["International Standard Recording Code: USRC17607839"], ["USRC17607839"]),
        (("024", "1", "|z036000291452"), ["Universal Product Code: 036000291452 [Invalid]"], ["036000291452"]),
        (("024", "3", "|a4006381333931|d51000"), ["International Article Number: 4006381333931 51000"], ["4006381333931 51000"]),
        (("024", "7", "|aA02-2009|2istc"), ["International Standard Text Code: A02-2009"], ["A02-2009"]),
        (("024", "7", "|a10.1000/182|2doi"), ["10.1000/182 (source: doi)"], ["10.1000/182"]),
        (("024", "8", "|a77"), ["[Unknown Type]: 77"], ["77"]),
        (("026", " ", "|adete nkck|bvess lodo 3|cAnno|2fei"), ["Fingerprint ID: dete nkck vess lodo 3 Anno"], ["dete nkck vess lodo 3 Anno"]),
        (("028", "0", "|aLSC 2398|bDecca"), ["Publisher Number, Decca: LSC 2398"], ["LSC 2398"]),
        (("028", "6", "|aDV98|bFacets"), ["Distributor Number, Facets: DV98"], ["DV98"]),
        (("030", " ", "|aJPHYA7|zJPHYB8"), ["CODEN: JPHYA7", "CODEN: JPHYB8 [Invalid]"], ["JPHYA7", "JPHYB8"]),
        (("088", " ", "|aNASA-RP-1124"), ["Report Number: NASA-RP-1124"], ["NASA-RP-1124"]),
    ],
)
def test_other_standard_numbers(spark, field, shown, numbers):
    assert standard(spark, field) == only("other_standard_numbers_display", shown, numbers)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("   85153773 ", "85153773"),
        ("85-2 /AC", "85000002"),
        ("2001-1114", "2001001114"),
        ("gm 71-2450", "gm71002450"),
        ("79-1391011", "791391011"),
    ],
)
def test_lccn(spark, given, want):
    got = control(spark, ("010", " ", f"|a{given}"))
    raw = given.strip()
    assert got["lccn_number"] == want
    assert got["all_control_numbers"] == got["control_numbers_search"] == ([want] if want == raw else [want, raw])
    assert got["lccns_display"] == [raw if want == raw else f"{raw} (i.e., {want})"]


@pytest.mark.parametrize("given", ["ocm00012345", "ocn12345", "on0012345", "12345"])
def test_oclc_prefixes(spark, given):
    for got in (control(spark, ("001", None, given)), control(spark, ("035", " ", f"|a(OCoLC){given}"))):
        assert got == {"oclc_numbers_display": ["12345"], "oclc_numbers": ["12345"], "all_control_numbers": ["12345"], "control_numbers_search": ["12345"]}


def test_field_001_is_judged_last(spark):
    # valid 035: another 001 is invalid and stands behind, whatever the order of the fields
    got = control(spark, ("001", None, "ocm00012345"), ("035", " ", "|a(OCoLC)999"))
    assert got == {"oclc_numbers_display": ["999", "12345 [Invalid]"], "oclc_numbers": ["999"], "all_control_numbers": ["999", "12345"], "control_numbers_search": ["999", "12345"]}
    # no valid 035: the 001 is valid and stands in front, but not in the search
    got = control(spark, ("001", None, "12345"), ("035", " ", "|z(OCoLC)on999"))
    assert got == {"oclc_numbers_display": ["12345", "999 [Invalid]"], "oclc_numbers": ["12345"], "all_control_numbers": ["12345", "999"], "control_numbers_search": ["999", "12345"]}
    # told already: once, with the suffix as a further search term
    got = control(spark, ("001", None, "12345/ab"), ("035", " ", "|a(OCoLC)on012345"))
    assert got == {"oclc_numbers_display": ["12345"], "oclc_numbers": ["12345"], "all_control_numbers": ["12345"], "control_numbers_search": ["12345", "12345/ab"]}
    # no OCLC number: it stays valid
    got = control(spark, ("001", None, "ybp77"), ("035", " ", "|a(OCoLC)12345"), ("035", " ", "|a(YBP)88"))
    assert got["other_control_numbers_display"] == ["88 (source: YBP)", "[Unknown Type]: ybp77"] and got["oclc_numbers"] == ["12345"]
    assert got["all_control_numbers"] == ["12345", "88", "ybp77"]


def test_other_control_numbers(spark):
    got = control(spark, ("010", " ", "|bms 89001579"), ("016", "7", "|a94.7|z94.8|2GyFmDB"), ("016", " ", "|a730032015  rev"))
    assert got["other_control_numbers_display"] == ["National Union Catalog Number: ms 89001579 (i.e., ms89001579)", "94.7 (source: GyFmDB)", "94.8 (source: GyFmDB) [Invalid]", "Library and Archives Canada Number: 730032015  rev"]
    assert "lccn_number" not in got


# --- headings ------------------------------------------------------------------

MAPPING = [("history", None, ["History"]), ("history", "texas", ["Texas history"]), ("20th century", None, ["Modern times"])]


def headings(spark, *given):
    mapping = spark.createDataFrame(MAPPING, "key string, parent string, facets array<string>")
    return told(S.record_headings(fields(spark, *given), mapping, [("^to ([0-9]+)$", [("era", "Until {}")])]))


def test_subject_terms_are_typed_by_tag(spark):
    df = fields(spark, ("651", " ", "|aTexas|2fast|0(OCoLC)1"), ("655", " ", "|aNovels."), ("648", " ", "|a1900-1999"), ("650", " ", "|aArt,|bmodern.|zFrance|yto 1900.|vExhibitions|4aut|0x"))
    got = {(r["heading"], r["kind"], r["term"], tuple(r["parents"])) for r in S.subject_headings(df).collect()}
    assert got == {
        ("Texas", "region", "Texas", ()),
        ("Novels", "genre", "Novels", ()),
        ("1900-1999", "era", "1900-1999", ()),
        ("Art, modern", "topic", "Art, modern", ()),
        ("Art, modern > France", "region", "France", ("Art, modern",)),
        ("Art, modern > France > to 1900", "era", "to 1900", ("Art, modern", "France")),
        ("Art, modern > France > to 1900 > Exhibitions", "genre", "Exhibitions", ("Art, modern", "France", "to 1900")),
    }


def test_headings_of_a_record(spark):
    got = headings(
        spark,
        ("651", " ", "|aTexas|xHistory|y20th century"),
        ("650", " ", "|aCows|xHistory|yto 1900"),
        ("650", " ", "|aCows|xHistory|yto 1900."),  # told already
        ("653", " ", "|aUncontrolled"),
        ("692", " ", "|aSearch only"),
        ("655", " ", "|aPoems|xHistory"),
        ("650", " ", "|2fast"),  # no term
    )
    assert got["subject_headings_display"] == ["Cows > History > to 1900", "Texas > History > 20th century", "Uncontrolled"]
    assert got["subjects_search_exact_headings"] == [*got["subject_headings_display"], "Search only"]
    assert got["subject_heading_facet"] == ["cows!Cows", "cows-history!Cows > History", "cows-history-to-1900!Cows > History > to 1900", "texas!Texas", "texas-history!Texas > History", "texas-history-20th-century!Texas > History > 20th century"]
    assert got["topic_facet"] == ["cows!Cows", "history!History", "texas-history!Texas history", "modern-times!Modern times"]
    assert got["region_facet"] == ["texas!Texas"]
    assert got["era_facet"] == ["until-1900!Until 1900", "20th-century!20th century"]
    assert got["genre_facet"] == ["poems!Poems", "poems-history!Poems, History"]
    assert got["genre_headings_display"] == ["Poems > History"] and got["genres_search_main_terms"] == ["Poems"]
    assert got["subjects_search_main_terms"] == ["Cows", "Texas", "Search only"]


def test_mapping_by_parent(spark):
    mapping = spark.createDataFrame(MAPPING, "key string, parent string, facets array<string>")
    terms = spark.createDataFrame([("History", "topic", ["Cows", "Texas"]), ("History", "topic", ["Cows"]), ("20th century", "era", []), ("to 99", "era", None), ("Plain", "genre", [])], "term string, kind string, parents array<string>")
    got = [(r["term"], r["facet_kind"], r["facet_term"]) for r in S.map_subdivisions(terms, mapping, [("^to ([0-9]+)$", [("era", "Until {}")])]).collect()]
    assert sorted(got) == sorted([("History", "topic", "Texas history"), ("History", "topic", "History"), ("20th century", "topic", "Modern times"), ("20th century", "era", "20th century"), ("to 99", "era", "Until 99"), ("Plain", "genre", "Plain")])
