"""Building documents from records: jobs over exploded fields, grouped back by record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.arrays import subfields
from ..functions.project import cat_fields, clean_url, strip_uris, suppressed
from .search import prefixes
from .shelflist import order_varfields

_EMPTY = "array<string>"


def ordered_list(order: Column | Sequence[Column], value: Column | str) -> Column:
    """Aggregate: values in an explicit order, never in that of arrival."""
    order = [order] if isinstance(order, Column) else list(order)
    v = F.col(value) if isinstance(value, str) else value
    made = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], v.alias("v"))
    return F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), made))), lambda x: x["v"])


def assemble_records(varfields: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their ordered fields and subfields, records without any field)."""
    parts = F.filter(F.split(F.when(F.col("content").startswith("|"), F.col("content")).otherwise(F.concat(F.lit("|a"), F.col("content"))), r"\|"), lambda p: p != "")
    subs = F.transform(parts, lambda p: F.struct(F.substring(p, 1, 1).alias("code"), F.substring(p, F.lit(2), F.length(p)).alias("value")))
    placed = order_varfields(varfields).withColumn("subfields", subs)
    nested = placed.groupBy("record_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "marc_tag", "occ_num", "subfields"))), lambda x: F.struct(x["marc_tag"].alias("tag"), x["subfields"].alias("subfields"))).alias("fields"))
    return records.join(nested, "record_num"), records.join(nested.select("record_num"), "record_num", "left_anti")


def call_numbers(varfields: DataFrame, spec: Sequence[tuple[str, str | None, str]]) -> DataFrame:
    """Per record the call numbers of the first (type code, tag, kind) that has any, in order of occurrence."""
    rank = kind = None
    for i, (code, tag, name) in enumerate(spec):
        hit = (F.col("type_code") == code) & (F.col("marc_tag").eqNullSafe(F.lit(tag)) if tag is not None else F.col("marc_tag").isNull())
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    text = F.trim(F.regexp_replace(F.regexp_replace("content", r"^\|.", ""), r"\|.", " "))
    found = varfields.withColumn("_rank", rank).withColumn("kind", kind).where("_rank IS NOT NULL").withColumn("call_number", text)
    best = found.groupBy("record_num").agg(F.min("_rank").alias("_best"))
    return found.join(best, "record_num").where("_rank = _best").groupBy("record_num", "kind").agg(ordered_list(F.col("occ_num"), "call_number").alias("call_numbers"))


def shelving_call_number(items: DataFrame, bibs: DataFrame, key: str, item_number: str, item_kind: str, bib_number: str, bib_kind: str, title: str) -> DataFrame:
    """D3: the item's call number, else the bib's; ``shelved by title`` gets the title behind it."""
    both = items.join(bibs.select(key, bib_number, bib_kind, title), key, "left")
    number = F.coalesce(item_number, bib_number)
    kind = F.when(F.col(item_number).isNotNull(), F.col(item_kind)).otherwise(F.col(bib_kind))
    by_title = F.lower(number).rlike(r"^shelved by title")
    return both.withColumn("shelving_number", F.when(by_title, F.concat_ws(" ", number, F.col(title))).otherwise(number)).withColumn("shelving_kind", F.when(number.rlike(r"^[A-Z]{1,4} ?[0-9.]+:"), "sudoc").otherwise(kind))


def call_number_fields(items: DataFrame) -> DataFrame:
    """Sort and search keys of call number and volume.

    The long chain of a call number's sort key is computed once for every
    distinct one, then joined: items share them by the copy.
    """
    n, kind = F.col("call_number"), F.col("call_number_type")
    numbers = items.where(n.isNotNull()).select(n.alias("_n"), kind.alias("_kind")).distinct()
    numbers = numbers.select("_n", "_kind", K.sort_key(F.col("_n"), F.col("_kind")).alias("call_number_sort"), K.search_key(F.col("_n")).alias("call_number_search"))
    keyed = items.join(numbers, (n == F.col("_n")) & kind.eqNullSafe(F.col("_kind")), "left")
    return keyed.withColumn("volume_sort", K.volume_key(F.col("volume"))).drop("_n", "_kind")


#: What an item document's full text is made of, in this order (fixed values).
ITEM_TEXT = ("id", "parent_bib_id", "call_number", "volume", "barcode", "long_messages", "internal_notes", "public_notes", "location_code", "parent_bib_title", "parent_bib_main_author", "parent_bib_publication_year")
#: Item fields by type code of their variable fields (fixed values); notes of several codes stand in that order.
ITEM_FIELD, ITEM_FIELDS = {"v": "volume", "b": "barcode"}, {"long_messages": ("m",), "internal_notes": ("x", "n"), "public_notes": ("p",)}


def item_field_columns(rows: Column) -> dict[str, Column]:
    """What an item's fields (type_code, occ_num, content) tell: barcode and volume (the first of each), lists of messages and notes."""
    placed = lambda codes: F.array_sort(F.transform(F.filter(rows, lambda f: f["type_code"].isin(*codes)), lambda f: F.struct(F.array_position(F.array(*map(F.lit, codes)), f["type_code"]).alias("place"), f["occ_num"].alias("occ_num"), f["content"].alias("content"))))
    one = {name: F.get(placed([code]), F.lit(0))["content"] for code, name in ITEM_FIELD.items()}
    return one | {name: F.filter(F.transform(placed(codes), lambda x: x["content"]), lambda v: v.isNotNull()) for name, codes in ITEM_FIELDS.items()}


def item_fields(varfields: DataFrame, key: str) -> DataFrame:
    """Barcode, volume (the first of each) and lists of messages and notes of every item that has any."""
    listed = _wanted(varfields).groupBy(key).agg(F.collect_list(F.struct("type_code", "occ_num", "content")).alias("_fields"))
    return listed.select(key, *[c.alias(name) for name, c in item_field_columns(F.col("_fields")).items()])


def _wanted(varfields: DataFrame) -> DataFrame:
    return varfields.where(F.col("type_code").isin([*ITEM_FIELD, *[c for codes in ITEM_FIELDS.values() for c in codes]]))


def met_items(items: DataFrame, varfields: DataFrame, checkouts: DataFrame, key: str, parent: str) -> DataFrame:
    """Items with what their fields and their checkout tell, all of which name the parent too; ``_at`` names it.

    Rows of all three are shuffled once, by parent (those without one by their
    own key), and listed by key there; parents meet them without another.
    """
    at = F.coalesce(F.concat(F.lit("p"), F.col(parent)), F.concat(F.lit("i"), F.col(key)))
    row = lambda df, name, columns: df.select(at.alias("_at"), key, F.struct(*columns).alias(name))
    told = [c for c in checkouts.columns if c not in (key, parent)]
    rows = row(items, "_item", [c for c in items.columns if c != key])
    rows = rows.unionByName(row(_wanted(varfields).where(F.col(key).isNotNull()), "_field", ["type_code", "occ_num", "content"]), allowMissingColumns=True)
    rows = rows.unionByName(row(checkouts.where(F.col(key).isNotNull()), "_checkout", told), allowMissingColumns=True)
    listed = rows.repartition("_at").groupBy("_at", key).agg(F.collect_list(F.struct("_item", "_field", "_checkout")).alias("_rows"))
    of = lambda name: F.transform(F.filter("_rows", lambda r: r[name].isNotNull()), lambda r: r[name])
    met = listed.select("_at", key, F.explode(of("_item")).alias("_item"), of("_field").alias("_fields"), F.get(of("_checkout"), F.lit(0)).alias("_checkout"))
    return met.select("_at", key, "_item.*", *[c.alias(name) for name, c in item_field_columns(F.col("_fields")).items()], *[F.col("_checkout")[c].alias(c) for c in told])


def item_documents(items: DataFrame, fields: DataFrame | Column, bibs: DataFrame | Column, checkouts: DataFrame | Column, key: str = "item_id", parent: str = "bib_num") -> DataFrame:
    """Items with their notes, call-number keys, what their bib tells, their checkout, suppression and full text.

    ``items`` has call_number, call_number_type, item_code and item_type_code;
    ``fields`` is ``item_fields``; ``bibs`` has bib_id, call_number,
    call_number_type, title, author, year and suppressed; ``checkouts`` (key,
    due_date, checkout_date, overdue_date, recall_date) at most one an item.
    An item without a call number takes its bib's.

    Where ``fields`` are variable fields, and these and checkouts name their
    item's bib, items are shuffled once (``met_items``).  Items that hold what
    they are told need no tables: then ``fields`` is a column of arrays of
    (type_code, occ_num, content), ``checkouts`` one of structs, ``bibs`` a
    table or one of structs (null without a bib), all told from an item's other
    columns where its document is made, so that no shuffle carries them.  Keys
    are computed row by row: documents are too wide to be shuffled by call
    number.
    """
    of_bib = {"bib_id": "parent_bib_id", "title": "parent_bib_title", "author": "parent_bib_main_author", "year": "parent_bib_publication_year", "call_number": "_bib_number", "call_number_type": "_bib_kind", "suppressed": "_bib_suppressed"}
    held = isinstance(fields, Column) and isinstance(checkouts, Column)
    if isinstance(bibs, Column):
        out = items.withColumn("_bib", bibs).select("*", *[F.col("_bib")[c].alias(n) for c, n in of_bib.items()]).drop("_bib")
    else:
        parents = bibs.select(parent, *[F.col(c).alias(n) for c, n in of_bib.items()])
        if held:
            out = items.join(parents, parent, "left")
        elif parent in fields.columns and parent in checkouts.columns:
            parents = parents.withColumn("_at", F.concat(F.lit("p"), F.col(parent))).drop(parent)
            out = met_items(items, fields, checkouts, key, parent).join(parents, "_at", "left").drop("_at")
        else:
            out = items.join(fields, key, "left").join(parents, parent, "left").join(checkouts, key, "left")
    if held:
        out = out.withColumns({"_fields": fields, "_checkout": checkouts})
        out = out.withColumns(item_field_columns(F.col("_fields"))).select("*", "_checkout.*").drop("_fields", "_checkout")
    none = F.array().cast(_EMPTY)
    out = out.withColumns(
        {
            "id": F.col(key).cast("string"),
            "type": F.lit("Item"),
            "parent_bib_main_author": strip_uris(F.col("parent_bib_main_author")),
            "call_number_type": F.when(F.col("call_number").isNotNull(), F.col("call_number_type")).otherwise(F.col("_bib_kind")),
            "call_number": F.coalesce("call_number", "_bib_number"),
            "item_type_code": F.col("item_type_code").cast("string"),
            "suppressed": suppressed(F.col("item_code"), F.col("_bib_suppressed")),
            **{name: F.coalesce(name, none) for name in ITEM_FIELDS},
        }
    ).drop("_bib_number", "_bib_kind", "_bib_suppressed")
    n = F.col("call_number")
    keyed = out.withColumns({"call_number_sort": K.sort_key(n, F.col("call_number_type")), "call_number_search": K.search_key(n), "volume_sort": K.volume_key(F.col("volume"))})
    return cat_fields(keyed, include=list(ITEM_TEXT))


#: E-resource columns by type code: the first field of a code, or all of them (fixed values).
RESOURCE_FIELD = {"v": "eresource_type", "t": "title", "e": "summary", "k": "alert"}
RESOURCE_FIELDS = {"d": "subjects", "n": "internal_notes", "f": "public_notes"}
RESOURCE_TEXT = ("id", "eresource_type", "publisher", "title", "alternate_titles", "subjects", "summary", "holdings")


def resource_documents(resources: DataFrame, varfields: DataFrame, holdings: DataFrame, providers: DataFrame, key: str, position: str, holding: str) -> DataFrame:
    """E-resources with the fields of their record, their provider's title, ordered holdings, URL, suppression and full text.

    ``resources`` has the key, provider, url and resource_code (not suppressed:
    ``-``), ``varfields`` (key, type_code, occ_num, content), ``holdings`` (key,
    position, holding), ``providers`` (provider, title).  Alternate titles are
    the distinct ``x`` fields and the first ``p``, without the title.
    """
    of = lambda code: F.when(F.col("type_code") == code, F.col("content"))
    first = lambda code: F.min_by(of(code), F.when(F.col("type_code") == code, F.struct("occ_num", "content")))
    told = varfields.groupBy(key).agg(
        *[first(code).alias(name) for code, name in RESOURCE_FIELD.items()],
        *[ordered_list(F.col("occ_num"), of(code)).alias(name) for code, name in RESOURCE_FIELDS.items()],
        F.collect_set(of("x")).alias("_x"),
        first("p").alias("_p"),
    )
    none = F.array().cast(_EMPTY)
    listed = holdings.groupBy(key).agg(ordered_list(F.col(position), holding).alias("holdings"))
    out = resources.join(told, key, "left").join(listed, key, "left").join(providers.select("provider", F.col("title").alias("publisher")), "provider", "left")
    others = F.array_sort(F.filter(F.array_union(F.coalesce("_x", none), F.array("_p")), lambda t: t.isNotNull() & ~t.eqNullSafe(F.col("title"))))
    out = out.withColumns(
        {
            "id": F.col(key).cast("string"),
            "type": F.lit("eResource"),
            "alternate_titles": others,
            "external_url": clean_url(F.col("url")),
            "suppressed": ~F.col("resource_code").eqNullSafe(F.lit("-")),
            **{name: F.coalesce(name, none) for name in (*RESOURCE_FIELDS.values(), "holdings")},
        }
    )
    return cat_fields(out.drop("_x", "_p", "url"), include=list(RESOURCE_TEXT))


def code_documents(codes: DataFrame, code: str, label: str, type_name: str) -> DataFrame:
    """D7"""
    return codes.select(F.concat_ws(".", F.lit(type_name), F.col(code)).alias("id"), F.lit(type_name).alias("type"), F.col(code).cast("string").alias("code"), F.col(label).alias("label"), F.concat_ws(" ", F.col(code), F.col(label)).alias("text"))


def item_json(items: DataFrame, key: str, n: int = 3) -> DataFrame:
    """A bib's items as JSON in display order: the first ``n`` and the rest; copies after the first carry `` c.N``."""
    copy = F.when(F.col("copy_number") > 1, F.concat(F.lit(" c."), F.col("copy_number"))).otherwise("")
    shown = items.withColumn("cn", F.when(F.col("volume").isNull(), F.concat("call_number", copy)).otherwise(F.col("call_number"))).withColumn("vol", F.concat("volume", copy))
    made = F.to_json(F.struct(F.col("item_id").alias("i"), F.col("cn").alias("c"), F.col("vol").alias("v"), F.col("location_code").alias("l")))
    order = [F.coalesce(F.col("display_order").cast("long"), F.lit(2**31)), F.col("item_id")]
    listed = shown.groupBy(key).agg(ordered_list(order, made).alias("_all"))
    a = F.col("_all")
    return listed.select(key, F.slice(a, 1, n).alias("items_json"), (F.size(a) > n).alias("has_more_items"), F.slice(a, n + 1, F.greatest(F.size(a), F.lit(1))).alias("more_items_json"))


def bib_call_numbers(own: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Distinct call numbers of bib and items in the order in which they are first seen, the bib's before those of its items; sudocs apart, each with its prefixes.

    ``own`` is (key, position, call_number, kind), ``items`` the same with the
    items' places in display order.
    """
    both = own.select(key, F.lit(0).alias("_of"), "position", "call_number", "kind").unionByName(items.select(key, F.lit(1).alias("_of"), "position", "call_number", "kind"))
    rows = both.where("call_number IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_of", "position", "call_number", "kind"))).alias("_rows"))
    numbers = call_number_columns(F.col("_rows"))
    return rows.select(key, *[c.alias(n) for n, c in numbers.items()])


def call_number_columns(rows: Column) -> dict[str, Column]:
    """The columns that a record's call numbers fill, from rows in order with call_number and kind."""
    of = lambda doc: F.array_distinct(F.transform(F.filter(rows, lambda r: r["kind"].eqNullSafe(F.lit("sudoc")) == F.lit(doc)), lambda r: r["call_number"]))
    terms = lambda numbers: F.flatten(F.transform(numbers, prefixes))
    return {"call_numbers": of(False), "call_numbers_search": terms(of(False)), "sudocs": of(True), "sudocs_search": terms(of(True))}


#: File endings of images (fixed values).
IMAGE_ENDINGS = ("apng", "bmp", "gif", "ico", "cur", "jpg", "jpeg", "jfif", "pjpeg", "pjp", "png", "svg", "tif", "tiff", "webp")
#: What a note says of a full text (fixed values).
FULLTEXT_NOTE = r"(^|\s)([Ee]lectronic|[Ee].?[Rr]esource|[Oo]nline.?|[Ff]ull.?[Tt]ext.?)(\s|$)"


def is_image(url: Column) -> Column:
    return F.lower(F.element_at(F.split(url, r"\."), -1)).isin(*IMAGE_ENDINGS)


def record_links(urls: Column, booking_host: str, reserve_url: Column, online: Column) -> Column:
    """(url, note, label, url_type) of a record's links, from its (tag, position, ind2, url, notes, labels, title) in order.

    Links of 856 without a URL are left out; they are full text if the second
    indicator is 0 or 1.  Those of 962 are media, or with no URL full text at
    ``reserve_url``; pictures among them are left out, 856 come first.  Then:
    booking host before full-text note before the only link of a record with
    an online item (``online``).
    """
    media = lambda u: u["tag"] == "962"

    def one(u: Column) -> Column:
        return F.struct(
            media(u).cast("int").alias("media"),
            u["position"].alias("position"),
            F.when(media(u), F.coalesce(u["url"], reserve_url)).otherwise(clean_url(u["url"])).alias("url"),
            F.when(media(u), u["title"]).otherwise(F.nullif(F.array_join(u["notes"], " "), F.lit(""))).alias("note"),
            F.when(~media(u), F.nullif(F.array_join(u["labels"], " "), F.lit(""))).alias("label"),
            F.when(media(u), F.when(u["url"].isNull(), "fulltext").otherwise("media")).when(u["ind2"].isin("0", "1"), "fulltext").otherwise("link").alias("kind"),
        )

    made = F.transform(F.filter(urls, lambda u: media(u) | u["url"].isNotNull()), one)
    shown = F.array_sort(F.filter(made, lambda u: (u["media"] == 0) | ~F.coalesce(is_image(u["url"]), F.lit(False))))

    def typed(all_: Column) -> Column:
        only_online = (F.size(all_) == 1) & F.coalesce(online, F.lit(False))
        kind = lambda u: F.when(u["url"].contains(booking_host), "booking").when(F.coalesce(u["note"], F.lit("")).rlike(FULLTEXT_NOTE), "fulltext").when(only_online, "fulltext").otherwise(u["kind"])
        return F.transform(all_, lambda u: F.struct(u["url"].alias("url"), u["note"].alias("note"), u["label"].alias("label"), kind(u).alias("url_type")))

    return K.let(shown, typed)


def _links_of(urls: DataFrame, key: str) -> DataFrame:
    return urls.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tag", "position", "ind2", "url", "notes", "labels", "title"))).alias("_urls"))


def url_list(urls: DataFrame, key: str, booking_host: str, reserve_url: Column, online: DataFrame | None = None) -> DataFrame:
    """(key, position, url, note, label, url_type) of ``record_links``; ``urls`` has key, tag, position, ind2, url, notes (their ``3`` and ``z``), labels (``y``) and title, ``online`` the keys of records with an online item."""
    rows = _links_of(urls, key)
    known = rows.withColumn("_online", F.lit(False)) if online is None else rows.join(online.select(key).distinct().withColumn("_online", F.lit(True)), key, "left")
    return known.select(key, F.posexplode(record_links(F.col("_urls"), booking_host, reserve_url, F.col("_online"))).alias("position", "_u")).select(key, "position", "_u.*")


def record_thumbnail(urls: Column, picture_hosts: Sequence[str], local_host: str) -> Column:
    """The first picture of 962, else the small form of the first 856 of a picture host (``picture_hosts``: what such URLs contain); a leading ``www.`` of ``local_host`` goes."""
    url = lambda u: clean_url(u["url"])
    hosted = lambda u: F.coalesce(F.array_max(F.transform(F.array(*map(F.lit, picture_hosts)), lambda h: url(u).contains(h))), F.lit(False))
    page = lambda u: F.regexp_replace(F.regexp_replace(F.regexp_replace(url(u), r"\?.*$", ""), "/+$", ""), "^http:", "https:")
    covers = F.filter(urls, lambda u: (u["tag"] == "962") & u["url"].isNotNull() & is_image(url(u)))
    cover = F.regexp_replace(clean_url(F.get(covers, F.lit(0))["url"]), rf"^https?://(www\.(?={local_host.replace('.', chr(92) + '.')}))?", "https://")
    small = F.get(F.transform(F.filter(urls, lambda u: (u["tag"] == "856") & u["url"].isNotNull() & hosted(u)), lambda u: F.concat(page(u), F.lit("/small/"))), F.lit(0))
    return F.coalesce(cover, small)


def thumbnails(urls: DataFrame, key: str, picture_hosts: Sequence[str], local_host: str) -> DataFrame:
    """(key, thumbnail_url) of ``record_thumbnail`` where there is one."""
    return _links_of(urls, key).select(key, record_thumbnail(F.col("_urls"), picture_hosts, local_host).alias("thumbnail_url")).where("thumbnail_url IS NOT NULL")


#: Dates in statements (fixed patterns): a year with unknown digits; then a century, decade or year, perhaps doubted; then perhaps the end of a range.
_YEAR = r"(?:[1-9](?:---|\?\?\?|uuu)|[1-9][0-9](?:--|\?\?|uu)|[1-9][0-9][0-9][-?u](?![0-9])|[1-9][0-9]{2,3}(?![0-9s]))"
_DATE = rf"(?i)(?<![0-9])([0-9]{{1,2}}(?:st|nd|rd|th)(?=.+centur)|[0-9]{{2,3}}0s|{_YEAR})\?*(?:(-)(?:\s*({_YEAR})|\s|$))?"


def extract_years(c: Column, limit: int) -> Column:
    """Array of (first, last) as coded: ``193u``, ``19uu``, ``9999`` for an open end, null without a range.

    ``limit`` is the last year taken for likely: three digits before an
    unknown one are a year of their own where they would lead beyond it.
    """
    plain = F.regexp_replace(c, r"[\[\]]", "")
    first, dash, second = (F.regexp_extract_all(plain, F.lit(_DATE), F.lit(k)) for k in (1, 2, 3))

    def year(y: Column) -> Column:
        known = F.regexp_extract(y, "^([0-9]+)[?uU]$", 1)
        kept = F.when(F.coalesce(known.try_cast("int") > limit / 10, F.lit(False)), known).otherwise(y)
        return F.lpad(F.regexp_replace(kept, "[?-]", "u"), 4, "0")

    def coded(y: Column) -> Column:
        return (
            F.when(F.lower(y).endswith("0s"), F.regexp_replace(y, "(?i)0s$", "u"))
            .when(y.rlike("(?i)(st|nd|rd|th)$"), F.concat((F.regexp_extract(y, "^([0-9]+)", 1).cast("int") - 1).cast("string"), F.lit("uu")))
            .otherwise(year(y))
        )

    def one(x: Column) -> Column:
        last = F.when(x["2"] != "", year(x["2"])).when(x["1"] != "", "9999")
        return F.struct(coded(x["0"]).alias("first"), last.alias("last"))

    zipped = F.arrays_zip(first.alias("0"), dash.alias("1"), second.alias("2"))
    return F.transform(zipped, one)


def coded_bounds(date: Column, limit: int) -> tuple[Column, Column]:
    """Lowest and highest year of a coded date; null if it is none, below 100 or after ``limit``."""
    ok = date.rlike("^[0-9u]{4}$") & ~date.isin("uuuu", "1uuu", "0uuu")
    low, high = F.replace(date, F.lit("u"), F.lit("0")).cast("int"), F.replace(date, F.lit("u"), F.lit("9")).cast("int")
    top = str(limit)
    approximate = date.isin(f"{top[0]}uuu", f"{top[:2]}uu", f"{top[:3]}u")
    high = F.when((high > limit) & approximate, F.lit(limit)).otherwise(high)
    good = ok & (low >= 100) & (high <= limit)
    return F.when(good, low), F.when(good, high)


def interpret_dates(kind: Column, date1: Column, date2: Column, serial: Column, limit: int, this_year: int) -> Column:
    """(low, high, field) of coded dates: a range for ranged kinds, else the first date alone."""
    low1, high1 = coded_bounds(date1, limit)
    open_end = F.trim(date2).isin("", "9999")
    low2, high2 = coded_bounds(date2, limit)
    low2, high2 = F.when(open_end, this_year).otherwise(low2), F.when(open_end, this_year).otherwise(high2)
    ranged = (serial & kind.isin("c", "d", "u")) | (~serial & kind.isin("i", "k", "m", "q"))
    low = F.when(ranged, F.coalesce(low1, low2)).otherwise(low1)
    high = F.when(ranged, F.greatest(low, F.coalesce(high2, high1))).otherwise(high1)
    field = F.when(kind.isin("i", "k"), "creation").when(kind == "p", "distribution").when(kind == "r", "distribution").otherwise("publication")
    return F.struct(low.alias("low"), high.alias("high"), F.when(low.isNotNull(), field).alias("field"))


def year_label(y: Column) -> Column:
    """A coded year for display: ``1960s``, ``20th century``, ``present year``, ``?``."""

    def century(c: Column) -> Column:
        suffix = F.when((c % 100).isin(11, 12, 13), "th").when(c % 10 == 1, "st").when(c % 10 == 2, "nd").when(c % 10 == 3, "rd").otherwise("th")
        return F.concat(c.cast("string"), suffix, F.lit(" century"))

    def label(y: Column) -> Column:
        number = F.coalesce(F.regexp_extract(y, "^([0-9]*)uu$", 1).try_cast("int"), F.lit(0)) + 1
        return (
            F.when(y == "9999", "present year")
            .when(y.rlike("^[0-9]*uu$"), K.let(number, century))
            .when(y.rlike("^[0-9]*u$"), F.regexp_replace(y, "u$", "0s"))
            .when(y.rlike("u"), "?")
            .otherwise(y)
        )

    return K.let(F.regexp_replace(y, "^0+", ""), label)


def range_label(first: Column, last: Column) -> Column:
    """Both ends; ``to present`` for an open one, ``(to ...)`` where the first may be later than the last."""
    high = lambda y: F.replace(y, F.lit("u"), F.lit("9")).try_cast("int")

    def label(s: Column) -> Column:
        a, b, first, last = s["a"], s["b"], s["first"], s["last"]
        a_short = F.when(a.endswith("century") & b.endswith("century"), F.regexp_replace(a, " century$", "")).otherwise(a)
        return (
            F.when(first.isNull(), "")
            .when((a == "?") & (last.isNull() | (b == "?")), "dates unknown")
            .when(last.isNull() | (a == "present year"), a)
            .when(last == "9999", F.concat(a, F.lit(" to present")))
            .when((a != "?") & (high(first) >= high(last)), F.concat(a_short, F.lit(" (to "), b, F.lit(")")))
            .otherwise(F.concat(a_short, F.lit(" to "), b))
        )

    return K.let(F.struct(year_label(first).alias("a"), year_label(last).alias("b"), first.alias("first"), last.alias("last")), label)


def expand_years(df: DataFrame, low: str, high: str) -> DataFrame:
    """One row per year of a range."""
    return df.where(F.col(low).isNotNull() & (F.col(high) >= F.col(low))).withColumn("year", F.explode(F.sequence(low, high)))


def publication_lists(varfields: DataFrame, tag: str, place: str, publisher: str) -> DataFrame:
    """Sorted tidy places and publishers of a record."""
    parts = subfields(varfields.where(F.col("marc_tag") == tag)).withColumn("value", K.tidy(F.col("value"))).where("value <> ''")
    of = lambda code: F.array_sort(F.collect_set(F.when(F.col("code") == code, F.col("value"))))
    return parts.groupBy("record_num").agg(of(place).alias("places"), of(publisher).alias("publishers"))


#: What the second indicator of a statement says it is (fixed values).
STATEMENT_KINDS = {"0": "creation", "1": "publication", "2": "distribution", "3": "manufacture", "4": "copyright"}


def publication_statements(varfields: DataFrame, ind2: str = "ind2") -> DataFrame:
    """(record_num, kind, statements): statements of place, name and date by kind, in order.

    A statement ends with its date (``c``); one of 260 also tells a copyright
    date behind a comma; ``e f g`` are a manufacture statement.
    """
    fields = varfields.where(F.col("marc_tag").isin("260", "264"))
    parts = subfields(fields).withColumn("value", F.trim("value")).where("value <> '' AND code IN ('a', 'b', 'c', 'e', 'f', 'g')")
    field = ["record_num", "marc_tag", "occ_num"]
    before = Window.partitionBy(*field).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    made = F.col("code").isin("e", "f", "g")
    parts = parts.withColumn("_made", made).withColumn("_n", F.coalesce(F.sum((F.col("code") == "c").cast("int")).over(before), F.lit(0)))
    own_kind = F.coalesce(F.create_map(*[F.lit(x) for kv in STATEMENT_KINDS.items() for x in kv])[F.col(ind2)], F.lit("publication"))
    old = F.col("marc_tag") == "260"
    date = r",? *(?:©|\(c\)|c|copyright ) *([0-9]{4})$"
    told = F.when(old & (F.col("code") == "c"), F.regexp_replace("value", date, "")).otherwise(F.col("value"))
    right = F.when(old & (F.col("code") == "c") & F.col("value").rlike(date), F.concat(F.lit("©"), F.regexp_extract("value", date, 1)))
    lines = parts.groupBy(*field, ind2, "_made", F.when(F.col("_made"), 0).otherwise(F.col("_n")).alias("_n")).agg(
        F.array_join(F.filter(ordered_list(F.col("position"), told), lambda v: v != ""), " ").alias("_told"), F.max(right).alias("_right"), F.min("position").alias("_at")
    )
    kind = F.when(F.col("_made"), "manufacture").otherwise(own_kind)
    shown = lines.select("record_num", "occ_num", "_at", F.explode(F.array(F.struct(kind.alias("kind"), F.col("_told").alias("s")), F.struct(F.lit("copyright").alias("kind"), F.col("_right").alias("s")))).alias("x"))
    tidy = K.tidy(F.col("x.s"))
    return shown.where("x.s <> ''").groupBy("record_num", F.col("x.kind").alias("kind")).agg(ordered_list([F.col("occ_num"), F.col("_at")], tidy).alias("statements"))


def languages(coded: DataFrame, names: DataFrame, key: str, code: str, position: str) -> DataFrame:
    """Names of a record's languages in the order in which they are first seen; unknown codes are left out."""
    first = coded.groupBy(key, code).agg(F.min(position).alias("_p"))
    named = first.join(names, code).groupBy(key, "name").agg(F.min("_p").alias("_p"))
    return named.groupBy(key).agg(ordered_list(F.col("_p"), "name").alias("languages"))


#: What a language of a category (subfield code) is said of, in this order (fixed values).
LANGUAGE_NOTES = (("a", "Item language(s)"), ("b", "Summaries or abstracts"), ("d", "Sung or spoken text"), ("e", "Librettos"), ("f", "Tables of contents"), ("g", "Accompanying materials"), ("h", "Original language"), ("j", "Subtitles"))


def language_notes(coded: DataFrame, names: DataFrame, key: str, code: str, category: str, position: str) -> DataFrame:
    """(key, language_notes): one note per category, its languages in the order in which they are first seen."""
    first = coded.join(names, code).groupBy(key, category, "name").agg(F.min(position).alias("_p"))
    listed = first.groupBy(key, category).agg(F.array_join(ordered_list(F.col("_p"), "name"), ", ").alias("_names"))
    label = rank = None
    for i, (c, text) in enumerate(LANGUAGE_NOTES):
        hit = F.col(category) == c
        label, rank = (F.when(hit, text), F.when(hit, i)) if label is None else (label.when(hit, text), rank.when(hit, i))
    known = listed.withColumn("_rank", rank).where("_rank IS NOT NULL")
    return known.groupBy(key).agg(ordered_list(F.col("_rank"), F.concat(label, F.lit(": "), F.col("_names"))).alias("language_notes"))


#: A token of the games note (fixed pattern): facet letter, lowest and highest number.
GAME_TOKEN = r"([adp])([0-9]+)(?:to|t)?([0-9]+)?(?:;+|\s|$)"


#: How codes of locations with games begin (fixed value).
GAME_LOCATIONS = "czm"


def game_labels(note: Column) -> Column:
    """(facet, low, high, label) of the tokens of a note such as ``a13t100;d30t59;p2t4``.

    A label has a sort key before ``!``: both numbers, padded to the length of
    the facet's upper bound.  Minutes from 59 on are hours; from 500 minutes, 99
    players or 100 years on a range is open above, one from a single minute on
    is open below.  A token without a second number has high 0.
    """
    one, two, three = (F.regexp_extract_all(F.lower(note), F.lit(GAME_TOKEN), F.lit(k)) for k in (1, 2, 3))
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    tokens = F.transform(F.arrays_zip(one.alias("0"), two.alias("1"), three.alias("2")), lambda t: F.struct(t["0"].alias("facet"), number(t["1"]).alias("low"), number(t["2"]).alias("high")))
    return F.transform(tokens, lambda t: t.withField("label", _game_label(t["facet"], t["low"], t["high"])))


def _game_label(facet: Column, low: Column, high: Column) -> Column:
    def said(n: Column) -> tuple[Column, Column]:
        """(number, unit) as shown."""
        hours = (facet == "d") & (n >= 59)
        shown = F.when(hours, F.bround(n / 60).cast("int")).otherwise(n)
        unit = F.when(hours, "hour").when(facet == "d", "minute").when(facet == "p", "player").otherwise("year")
        return shown.cast("string"), F.concat(unit, F.when(shown == 1, "").otherwise("s"))

    (a, a_unit), (b, b_unit) = said(low), said(high)
    above = F.when(facet == "d", 500).when(facet == "p", 99).otherwise(100)
    less, less_unit = said(high + 1)
    more, more_unit = said(low - 1)
    same = F.regexp_replace(a_unit, "s$", "") == F.regexp_replace(b_unit, "s$", "")
    shown = (
        F.when(high == 0, F.concat_ws(" ", a, a_unit))
        .when((facet == "d") & (low <= 1), F.concat_ws(" ", F.lit("less than"), less, less_unit))
        .when((high >= above) & (facet == "a"), F.concat_ws(" ", a, a_unit, F.lit("and up")))
        .when(high >= above, F.concat_ws(" ", F.lit("more than"), more, more_unit))
        .otherwise(F.concat_ws(" ", a, F.when(~same, a_unit), F.lit("to"), b, b_unit))
    )
    width = F.length(above.cast("string"))
    padded = lambda n: F.lpad(n.cast("string"), F.greatest(width, F.length(n.cast("string"))), "0")
    return F.concat(padded(low), F.lit("-"), padded(F.when(high == 0, low).otherwise(high)), F.lit("!"), shown)


def game_facets(df: DataFrame, key: str, note: str, locations: str = "locations", family: str = GAME_LOCATIONS) -> DataFrame:
    """(key, position, facet, low, high, label) of ``game_labels``, of records at a location of one family."""
    at = F.exists(locations, lambda l: l.startswith(family))
    return df.where(F.coalesce(at, F.lit(False))).select(key, F.posexplode(game_labels(F.col(note))).alias("position", "_g")).select(key, "position", "_g.*")


def author_facets(names: DataFrame, key: str, heading: str, tag: str, position: str, combined: str = "combined") -> DataFrame:
    """Per record its author (the 1XX), distinct contributors in order, meetings apart, and the author sort key.

    Names that are both organisation and event (``combined``) are left out.
    """
    distinct = names.where(~F.coalesce(F.col(combined), F.lit(False))).groupBy(key, heading).agg(F.min(position).alias("_p"), F.min_by(tag, position).alias("_tag"))
    event = F.col("_tag").substr(2, 2) == "11"
    first = F.col("_tag").substr(1, 1) == "1"
    return (
        distinct.groupBy(key)
        .agg(
            F.min_by(F.when(first & ~event, F.col(heading)), F.struct(~(first & ~event), F.col("_p"))).alias("author"),
            ordered_list(F.col("_p"), F.when(~first & ~event, K.keyed_facet(F.col(heading)))).alias("contributors"),
            ordered_list(F.col("_p"), F.when(event, K.keyed_facet(F.col(heading)))).alias("meetings"),
            F.min_by(F.when(~event, F.col(heading)), F.struct(event, F.col("_p"))).alias("_sort"),
        )
        .withColumn("author_sort", K.facet_key(F.col("_sort")))
        .drop("_sort")
    )


def title_facets(titles: DataFrame, key: str, title: str, kind: str, position: str, late_kind: str) -> DataFrame:
    """Titles by work key, the first of each kept; those of ``late_kind`` only where no other has their key."""
    keyed = titles.withColumn("work_key", K.facet_key(F.col(title)))
    first = keyed.where(F.col(kind) != late_kind).groupBy(key, kind, "work_key").agg(F.min_by(title, position).alias(title))
    late = keyed.where(F.col(kind) == late_kind).groupBy(key, kind, "work_key").agg(F.min_by(title, position).alias(title))
    return first.unionByName(late.join(first.select(key, "work_key").hint("merge"), [key, "work_key"], "left_anti"))  # as many works as titles: never broadcast


def notes(varfields: DataFrame, by_tag: Mapping[str, str], by_type: Mapping[str, str], skip_tags: Sequence[str] = ()) -> DataFrame:
    """(record_num, target, notes): the target of a field's tag, else of its type code unless its tag is skipped."""
    pick = lambda column, mapping: F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col(column)] if mapping else F.lit(None)
    skipped = F.coalesce(F.col("marc_tag").isin(*skip_tags), F.lit(False)) if skip_tags else F.lit(False)
    target = F.coalesce(pick("marc_tag", by_tag), F.when(~skipped, pick("type_code", by_type)))
    text = F.trim(F.regexp_replace(F.regexp_replace("content", r"^\|.", ""), r"\|.", " "))
    order = [F.coalesce("marc_tag", F.lit("")), F.col("occ_num")]
    return varfields.withColumn("target", target).where("target IS NOT NULL").groupBy("record_num", "target").agg(ordered_list(order, text).alias("notes"))


def linked_works(links: DataFrame, known: DataFrame, key: str, title: str, group: str, position: str, held_groups: Sequence[str]) -> DataFrame:
    """Linked titles by group, the first of each work; of ``held_groups`` only works that the record does not show already.

    ``known`` is (key, group, work_key): what the record's own fields tell of
    series and of included works, each held against links of its own group.
    """
    keyed = links.withColumn("work_key", K.facet_key(F.col(title))).groupBy(key, group, "work_key").agg(F.min_by(title, position).alias(title))
    held = keyed.where(F.col(group).isin(*held_groups)).join(known.select(key, group, "work_key").hint("merge"), [key, group, "work_key"], "left_anti")  # as many works as records: never broadcast
    return keyed.where(~F.col(group).isin(*held_groups)).unionByName(held)


def tagged_lists(varfields: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Contents of some tags as ordered lists, one column per target; null without any."""
    text = F.trim(F.regexp_replace(F.regexp_replace("content", r"^\|.", ""), r"\|.", " "))
    some = varfields.where(F.col("marc_tag").isin(*targets))
    return some.groupBy("record_num").agg(*[F.nullif(ordered_list(F.col("occ_num"), F.when(F.col("marc_tag") == tag, text)), F.array().cast(_EMPTY)).alias(name) for tag, name in targets.items()])


