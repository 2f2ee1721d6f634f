"""Standard and control numbers of records: typed by field, cleaned by kind, and settled per record."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import subfield_array
from ..functions.keys import let, strip_ends

STANDARD_TAGS = ("020", "022", "024", "025", "026", "027", "028", "030", "074", "088")
CONTROL_TAGS = ("010", "016", "035")
#: Kinds by tag, and of 024 by first indicator (fixed values).
KINDS = {"010": "lccn", "016": "lac", "020": "isbn", "022": "issn", "025": "oan", "026": "fingerprint", "027": "strn", "030": "coden", "035": "oclc", "074": "gpo", "088": "report"}
KINDS_024 = {"0": "isrc", "1": "upc", "2": "ismn", "3": "ean", "4": "sici", "8": "unknown"}
#: What kinds are called (fixed values); others are shown by their code as a source.
LABELS = {
    "isbn": "International Standard Book Number",
    "issn": "International Standard Serial Number",
    "issnl": "ISSN-L",
    "isrc": "International Standard Recording Code",
    "upc": "Universal Product Code",
    "ismn": "International Standard Music Number",
    "ean": "International Article Number",
    "sici": "Serial Item and Contribution Identifier",
    "istc": "International Standard Text Code",
    "unknown": "[Unknown Type]",
    "oan": "Overseas Acquisition Number",
    "fingerprint": "Fingerprint ID",
    "strn": "Standard Technical Report Number",
    "pn": "Publisher Number",
    "dn": "Distributor Number",
    "coden": "CODEN",
    "gpo": "Government Printing Office Item Number",
    "report": "Report Number",
    "nucmc": "National Union Catalog Number",
    "lac": "Library and Archives Canada Number",
}
#: Kinds that need no name in front of their numbers.
_PLAIN = ("isbn", "issn", "lccn", "oclc")
_ISBN = r"(?:^|\s)([0-9X\-]+)[^(]*(?:\((.+)\))?"
_SOURCE = r"(?s)^.([^)]*)\)(.*)$"
_ENTRY = "struct<number:string,normalized:string,valid:boolean,fault:string,kind:string,suffix:string>"
_NONE = "array<string>"


def _pick(key: Column, mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def normalized_lccn(c: Column) -> Column:
    """Without blanks and what follows a slash; six digits at least behind the first hyphen."""
    bare = F.split(F.replace(c, F.lit(" "), F.lit("")), "/")[0]
    right = F.regexp_extract(bare, "(?s)^[^-]*-(.*)$", 1)
    padded = F.lpad(right, F.greatest(F.lit(6), F.length(right)), "0")
    return F.when(bare.contains("-"), F.concat(F.regexp_extract(bare, "^[^-]*", 0), padded)).otherwise(bare)


def _qualifiers(c: Column) -> Column:
    """Parts of a qualifier, without marks and brackets around them."""
    return F.filter(F.split(F.regexp_replace(strip_ends(c), "[()]", ""), r"\s*[,;:]\s+"), lambda q: q != "")


def _entry(tag: Column, kind: Column, code: Column, value: Column) -> Column:
    """What one subfield tells; its number is null or empty if it is none."""
    z = F.when(kind == "issn", "Canceled").otherwise("Invalid")
    fault = F.when(code == "z", z).when(code == "m", "Canceled").when(code == "y", "Incorrect")

    def sourced(text: Column) -> Column:
        """The text, the source in brackets before it, and what follows."""
        has = text.rlike(_SOURCE)
        source = F.when(has, F.coalesce(_or_null(F.regexp_extract(text, _SOURCE, 1)), F.lit("unknown"))).otherwise("unknown")
        rest = F.trim(F.when(has, F.regexp_extract(text, _SOURCE, 2)).otherwise(text))
        return F.struct(text.alias("text"), source.alias("source"), rest.alias("rest"))

    def told(s: Column) -> Column:
        own = (kind == "oclc") & (s["source"] == "OCoLC")
        number = F.when(kind == "isbn", F.replace(F.regexp_extract(s["text"], _ISBN, 1), F.lit("-"), F.lit(""))).when(own, F.regexp_replace(s["rest"], "^[A-Za-z0]+", "")).when(kind == "oclc", s["rest"]).otherwise(s["text"])
        return F.struct(number.alias("number"), own.alias("own"), F.when(kind == "lccn", normalized_lccn(s["text"])).alias("lccn"), s["text"].alias("text"), s["source"].alias("source"))

    def entry(t: Column) -> Column:
        return F.struct(
            F.when(t["own"], F.regexp_extract(t["number"], "^[^/]*", 0)).otherwise(t["number"]).alias("number"),
            F.when(t["lccn"] != t["text"], t["lccn"]).alias("normalized"),
            code.isin("a", "b", "l").alias("valid"),
            fault.alias("fault"),
            F.when((kind == "issn") & code.isin("l", "m"), "issnl").when((tag == "010") & (code == "b"), "nucmc").when((kind == "oclc") & ~t["own"], t["source"]).alias("kind"),
            F.when(t["own"] & t["number"].contains("/"), F.regexp_extract(t["number"], "(?s)/.*$", 0)).alias("suffix"),
        )

    return let(let(let(F.trim(value), sourced), told), entry)


def numbers_of(fields: DataFrame, labels: Mapping[str, str] = LABELS) -> DataFrame:
    """Fields with ``numbers``: (number, normalized, valid, fault, kind, suffix, shown) of each of a field's numbers, in order.

    ``fields`` has marc_tag, ind1 and content.  A fold over the subfields: a
    number may be lengthened by a later subfield (024 ``d``), the parts of a
    fingerprint (026) are one number, and qualifiers (``q``, ``c``, brackets of
    an ISBN) go with all numbers of their field, as does the kind that ``2`` of
    016 and 024 names.  ``shown`` is the number as displayed, without its
    fault.
    """
    tag = F.col("marc_tag")
    kind = F.when(tag == "024", _pick(F.col("ind1"), KINDS_024)).when(tag == "028", F.when(F.col("ind1") == "6", "dn").otherwise("pn")).otherwise(_pick(tag, KINDS))
    out = fields.withColumn("_subs", subfield_array(F.col("content"))).withColumn("_kind", kind)
    subs, kind = F.col("_subs"), F.col("_kind")
    numeric = lambda s: (s["code"].isin("a", "l", "m", "y", "z") | ((tag == "010") & (s["code"] == "b"))) & (tag != "026")
    values = lambda test: F.transform(F.filter(subs, test), lambda s: s["value"])

    def fold(acc: Column, s: Column) -> Column:
        entry = _entry(tag, F.coalesce(kind, F.lit("")), s["code"], s["value"])
        last = _last(acc)
        longer = last.withField("number", F.concat_ws(" ", last["number"], s["value"]))
        return (
            F.when(numeric(s), F.concat(acc, F.filter(F.array(entry), lambda e: F.coalesce(e["number"], F.lit("")) != "")))
            .when((tag == "024") & (s["code"] == "d") & (F.size(acc) > 0), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))
            .otherwise(acc)
        )

    fingerprint = F.array_join(values(lambda s: s["code"].isin("a", "b", "c", "d", "e")), " ")
    null = F.lit(None).cast("string")
    one = F.struct(fingerprint.alias("number"), null.alias("normalized"), F.lit(True).alias("valid"), null.alias("fault"), null.alias("kind"), null.alias("suffix"))
    folded = F.aggregate(subs, F.array().cast(f"array<{_ENTRY}>"), fold)
    named = _last(values(lambda s: s["code"] == "2"))
    told = F.flatten(
        F.transform(
            subs,
            lambda s: F.when((kind == "isbn") & numeric(s), _qualifiers(F.regexp_extract(F.trim(s["value"]), _ISBN, 2)))
            .when(s["code"].isin("q", "c") & (tag != "026"), _qualifiers(s["value"]))
            .otherwise(F.array().cast(_NONE)),
        )
    )
    out = out.withColumns(
        {
            "_found": F.when(tag == "026", F.filter(F.array(one), lambda e: e["number"] != "")).otherwise(folded),
            "_told": F.array_join(told, ", "),
            "_publisher": F.when(tag == "028", _last(values(lambda s: s["code"] == "b"))),
            "_kind": F.coalesce(F.when(tag.isin("016", "024"), named), kind),
        }
    )

    def shown(e: Column) -> Column:
        other = ~e["kind"].isin(*_PLAIN)
        label = F.when(_pick(e["kind"], labels).isNotNull(), F.concat_ws(", ", _pick(e["kind"], labels), F.col("_publisher")))
        notes = F.concat_ws("; ", F.concat(F.lit("i.e., "), e["normalized"]), _or_null(F.col("_told")), F.when(other & label.isNull(), F.concat(F.lit("source: "), e["kind"])))
        return F.concat_ws(" ", F.when(other, F.concat(label, F.lit(":"))), e["number"], F.when(notes != "", F.concat(F.lit("("), notes, F.lit(")"))))

    typed = F.transform("_found", lambda e: e.withField("kind", F.coalesce(e["kind"], F.col("_kind"), F.lit("unknown"))))
    return out.withColumn("numbers", F.transform(typed, lambda e: e.withField("shown", shown(e)))).drop("_subs", "_kind", "_found", "_told", "_publisher")


def _with_fault(e: Column) -> Column:
    return F.concat_ws(" ", e["shown"], F.when(~e["valid"], F.concat(F.lit("["), e["fault"], F.lit("]"))))


def _all_forms(e: Column) -> Column:
    return F.filter(F.array(e["normalized"], e["number"]), lambda n: n.isNotNull())


def ordered_numbers(fields: DataFrame, key: str = "record_num") -> DataFrame:
    """(key, numbers) per record: those of all its fields by tag, then occurrence; ``fields`` as ``numbers_of`` gives them."""
    one = F.struct("marc_tag", "occ_num", "numbers")
    return fields.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda f: f["numbers"])).alias("numbers"))


def standard_number_columns(numbers: Column) -> dict[str, Column]:
    """The columns that a record's standard numbers fill; lists keep their order, null where empty."""
    of = lambda *kinds: F.filter(numbers, lambda e: e["kind"].isin(*kinds))
    issn = ("issn", "issnl")
    valid = lambda rows: F.array_distinct(F.transform(F.filter(rows, lambda e: e["valid"]), lambda e: F.coalesce(e["normalized"], e["number"])))
    every = F.flatten(F.transform(numbers, _all_forms))
    found = {
        "isbns_display": F.transform(of("isbn"), _with_fault),
        "issns_display": F.transform(of(*issn), _with_fault),
        "isbn_numbers": valid(of("isbn")),
        "issn_numbers": valid(of(*issn)),
        "other_standard_numbers_display": F.transform(F.filter(numbers, lambda e: ~e["kind"].isin("isbn", *issn)), _with_fault),
        "all_standard_numbers": every,
        "standard_numbers_search": every,
    }
    return {name: F.when(F.size(c) > 0, c) for name, c in found.items()}


def standard_numbers(varfields: DataFrame, key: str = "record_num", labels: Mapping[str, str] = LABELS) -> DataFrame:
    """(key, columns of ``standard_number_columns``) of records with standard numbers; ``varfields`` has marc_tag, ind1, occ_num and content."""
    found = ordered_numbers(numbers_of(varfields.where(F.col("marc_tag").isin(*STANDARD_TAGS)), labels), key)
    return found.select(key, *[c.alias(n) for n, c in standard_number_columns(F.col("numbers")).items()])


def settled_control_numbers(numbers: Column, own: Column, labels: Mapping[str, str] = LABELS) -> Column:
    """A struct of the columns that a record's control numbers fill, from those of its fields and the content ``own`` of its field 001.

    One fold over the numbers with 001 last: of equal numbers the first
    counts, and an OCLC number of 001 is valid only if the fields told no
    valid one; it then stands before the others.  Any other 001 is valid.
    """
    own_oclc = own.rlike(r"^(on|ocm|ocn)?[0-9]+(/.+)?$")
    as_field = F.when(own_oclc, F.concat(F.lit("(OCoLC)"), own)).otherwise(own)
    label = lambda e: _pick(e["kind"], labels)
    named = lambda e: F.when(own_oclc, e["number"]).otherwise(F.coalesce(F.concat(label(e), F.lit(": "), e["number"]), F.concat(e["number"], F.lit(" (source: "), e["kind"], F.lit(")"))))
    told = F.filter(F.array(_entry(F.lit("035"), F.lit("oclc"), F.lit("a"), as_field)), lambda e: F.coalesce(e["number"], F.lit("")) != "")
    last = F.transform(
        told,
        lambda e: F.struct(
            F.struct(e["number"].alias("number"), e["normalized"].alias("normalized"), e["valid"].alias("valid"), F.lit("Invalid").alias("fault"), F.coalesce(e["kind"], F.lit("oclc")).alias("kind"), e["suffix"].alias("suffix"), named(e).alias("shown")).alias("e"),
            F.lit(True).alias("late"),
        ),
    )
    none = F.array().cast(_NONE)
    early = F.transform(F.coalesce(numbers, F.array().cast(f"array<{_ENTRY[:-1]},shown:string>>")), lambda e: F.struct(e.alias("e"), F.lit(False).alias("late")))

    def fold(acc: Column, x: Column) -> Column:
        e = x["e"]
        main = F.coalesce(e["normalized"], e["number"])
        oclc = e["kind"] == "oclc"
        seen = F.struct(
            main.alias("main"),
            _all_forms(e).alias("forms"),
            (~F.array_contains(acc["all_control_numbers"], main)).alias("new"),
            F.when(x["late"] & oclc, F.size(acc["oclc_numbers"]) == 0).otherwise(e["valid"]).alias("valid"),
            F.when(e["kind"].isin("lccn", "oclc"), e["kind"]).otherwise("other").alias("kind"),
            F.concat(e["number"], e["suffix"]).alias("whole"),
        )
        return let(seen, lambda s: put(acc, x, s))

    def put(acc: Column, x: Column, s: Column) -> Column:
        front = x["late"] & (s["kind"] == "oclc") & s["valid"]
        display = F.array(F.concat_ws(" ", x["e"]["shown"], F.when(~s["valid"], F.concat(F.lit("["), x["e"]["fault"], F.lit("]")))))
        around = lambda name, more, test: F.when(test, F.when(front, F.concat(more, acc[name])).otherwise(F.concat(acc[name], more))).otherwise(acc[name])
        behind = lambda name, more, test: F.when(test, F.concat(acc[name], more)).otherwise(acc[name])
        good = lambda kind: s["new"] & s["valid"] & (s["kind"] == kind)
        search = behind("control_numbers_search", s["forms"], s["new"])
        return F.struct(
            around("lccns_display", display, s["new"] & (s["kind"] == "lccn")).alias("lccns_display"),
            around("oclc_numbers_display", display, s["new"] & (s["kind"] == "oclc")).alias("oclc_numbers_display"),
            around("other_control_numbers_display", display, s["new"] & (s["kind"] == "other")).alias("other_control_numbers_display"),
            behind("lccn", F.array(s["main"]), good("lccn")).alias("lccn"),
            behind("oclc_numbers", F.array(s["main"]), good("oclc")).alias("oclc_numbers"),
            around("all_control_numbers", s["forms"], s["new"]).alias("all_control_numbers"),
            let(search, lambda n: F.when(s["whole"].isNotNull() & ~F.array_contains(n, s["whole"]), F.array_append(n, s["whole"])).otherwise(n)).alias("control_numbers_search"),
        )

    return F.aggregate(F.concat(early, last), F.struct(*[none.alias(n) for n in ("lccns_display", "oclc_numbers_display", "other_control_numbers_display", "lccn", "oclc_numbers", "all_control_numbers", "control_numbers_search")]), fold)


CONTROL_COLUMNS = ("lccn_number", "lccns_display", "oclc_numbers_display", "other_control_numbers_display", "control_numbers_search", "oclc_numbers", "all_control_numbers")


def control_number_columns(settled: str) -> dict[str, Column]:
    """The columns of a struct of ``settled_control_numbers``, null where empty."""
    some = {n: F.when(F.size(F.col(f"{settled}.{n}")) > 0, F.col(f"{settled}.{n}")) for n in CONTROL_COLUMNS[1:]}
    return {"lccn_number": F.get(F.col(f"{settled}.lccn"), F.lit(0)), **some}


def control_numbers(varfields: DataFrame, key: str = "record_num", labels: Mapping[str, str] = LABELS) -> DataFrame:
    """(key, columns of ``control_number_columns``) of records with a 001 or control-number fields; of several 001 the last counts."""
    fields = numbers_of(varfields.where(F.col("marc_tag").isin("001", *CONTROL_TAGS)), labels)
    own = F.col("marc_tag") == "001"
    one = F.when(~own, F.struct("marc_tag", "occ_num", "numbers"))
    found = fields.groupBy(key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda f: f["numbers"])).alias("numbers"),
        F.max_by(F.when(own, F.col("content")), F.when(own, F.struct("occ_num", "content"))).alias("own"),
    )
    found = found.withColumn("_settled", settled_control_numbers(F.col("numbers"), F.col("own"), labels))
    return found.select(key, *[c.alias(n) for n, c in control_number_columns("_settled").items()])
