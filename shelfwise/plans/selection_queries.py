"""Queries for sources, selection, conditions and projections."""

from __future__ import annotations

from functools import reduce

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import project as J
from ..operators import edits as E
from ..operators import predicates as P
from ..operators import select as R
from ..sources import tables as S
from .registry import Registry
from .views import busiest_sql

reg = Registry()
add = reg.add

# --- sources ------------------------------------------------------------------

add("S1_load_tables", lambda c: c.nation.join(c.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"), "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


def _versions(c):
    old = c.items.select("item_id", "location_code", "status_code", F.col("price").alias("amount"))
    new = old.where("status_code = 'R'").withColumn("amount", F.col("amount") + 1).withColumn("location_code", F.lit("moved"))
    return old, new


_NEW = "SELECT item_id, 'moved' AS location_code, status_code, price + 1 AS amount FROM f_items WHERE status_code = 'R'"
add("S2_upsert", lambda c: E.upsert(*_versions(c), "item_id").select("item_id", "location_code", F.round("amount", 2).alias("amount")), f"SELECT item_id, location_code, round(amount, 2) AS amount FROM (SELECT item_id, location_code, price AS amount FROM f_items WHERE status_code <> 'R' UNION ALL SELECT item_id, location_code, amount FROM ({_NEW}))")
add("S3_delete_by_key", lambda c: E.delete_by_key(c.items.select("item_id", "copy_number"), c.items.where("deleted_date IS NOT NULL OR copy_number = 3"), "item_id"), "SELECT item_id, copy_number FROM f_items WHERE deleted_date IS NULL AND copy_number <> 3")
add("S4_clear_type", lambda c: E.clear_type(c.bibs.select("bib_num", F.when(F.col("bib_num") % 7 == 0, F.lit(None)).otherwise(F.col("status_code")).alias("type")), "F"), "SELECT * FROM (SELECT bib_num, CASE WHEN bib_num % 7 = 0 THEN NULL ELSE status_code END AS type FROM f_bibs) WHERE type IS DISTINCT FROM 'F'")


def _s5(c):
    docs = c.locations.select("location_code", F.when(F.col("region_num") < 2, "west").otherwise("east").alias("type"), "label")
    return E.reindex(docs, docs.where("type = 'west'").withColumn("label", F.lower("label")), "west")


add("S5_reindex", _s5, "SELECT location_code, CASE WHEN region_num < 2 THEN 'west' ELSE 'east' END AS type, CASE WHEN region_num < 2 THEN lower(label) ELSE label END AS label FROM f_locations")


def _s6(c):
    old, new = _versions(c)
    return E.apply_changes(old, new, c.items.where("deleted_date IS NOT NULL"), "item_id").select("item_id", "location_code")


add("S6_apply_changes", _s6, "SELECT item_id, CASE WHEN status_code = 'R' THEN 'moved' ELSE location_code END AS location_code FROM f_items WHERE deleted_date IS NULL")
add("S10_rows_to_batch", lambda c: S.rows_to_batch(c.customer.select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, "False").when(F.col("c_nationkey") % 3 == 1, "0").otherwise("yes").alias("a"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("T").alias("b")), {"read": "a", "write": "b"}).select("c_custkey", F.col("permissions")["read"].alias("may_read"), F.col("permissions")["write"].alias("may_write")), "SELECT c_custkey, c_nationkey % 3 = 2 AS may_read, c_custkey % 2 = 1 AS may_write FROM customer")

# --- selection ------------------------------------------------------------------

add("R1_select_full", lambda c: R.select_full(c.bibs.select("bib_num", "record_type"), c.orders.select(F.col("o_orderkey").alias("bib_num"), "o_totalprice"), "bib_num"), "SELECT o_orderkey AS bib_num, 'b' AS record_type, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
add("R2_select_since", lambda c: R.select_since(c.events.select("event_id", "ts"), "ts", datetime(2024, 1, 15)).select("event_id"), "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
add("R3_high_water_mark", lambda c: R.newest_runs(c.events, "user_id", "event_type", "ts", ("purchase", "signup")).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("mark")), "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS mark FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id")
add("R4_updated_between", lambda c: R.select_updated_between(c.bibs, "updated_ts", date(1995, 3, 1), date(1996, 3, 1), "America/Chicago").select("bib_num"), "SELECT bib_num FROM f_bibs WHERE updated_ts BETWEEN TIMESTAMP '1995-03-01 06:00:00' AND TIMESTAMP '1996-03-02 05:59:59.000099'")
add("R5_deleted_between", lambda c: R.select_deleted_between(c.items, "deleted_date", date(1995, 1, 1), date(1997, 12, 31)).select("item_id"), "SELECT item_id FROM f_items WHERE deleted_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'")
add("R6_select_with_related", lambda c: R.select_with_related(c.bibs, c.items, "bib_num", F.col("updated_ts") >= F.lit("1998-01-01").cast("timestamp"), F.col("copy_number") == 7).select("bib_num"), "SELECT bib_num FROM f_bibs WHERE updated_ts >= TIMESTAMP '1998-01-01' OR bib_num IN (SELECT bib_num FROM f_items WHERE copy_number = 7)")
add("R7_number_range", lambda c: R.select_number_range(c.bibs, "b100", "b900", number_col="bib_num").select("bib_num", "status_code"), "SELECT bib_num, status_code FROM f_bibs WHERE bib_num BETWEEN 100 AND 900")


def _bib_locations(c):
    return c.bibs.join(c.locations, F.col("bib_num") % 25 == F.col("location_num")).select("bib_num", "location_code")


_BIB_LOCATIONS = "SELECT bib_num, location_code FROM f_bibs JOIN f_locations ON bib_num % 25 = location_num"
add("R8_by_location", lambda c: R.select_by_location(c.bibs, _bib_locations(c), c.items, c.busiest(2)).select("bib_num"), f"SELECT bib_num FROM f_bibs WHERE bib_num IN (SELECT bib_num FROM f_items WHERE location_code IN {busiest_sql(2)}) OR bib_num IN (SELECT bib_num FROM ({_BIB_LOCATIONS}) WHERE location_code IN {busiest_sql(2)})")
reg.also("R8_by_location_whole", "R8_by_location")
add("R9_deletions", lambda c: R.deletions(c.bibs, "b").select("bib_num", F.col("deleted_date").cast("string").alias("deleted_on")), "SELECT bib_num, CAST(deleted_date AS VARCHAR) AS deleted_on FROM f_bibs WHERE deleted_date IS NOT NULL")
add("R10_dnf_filter", lambda c: R.dnf_filter(c.lineitem, [[F.col("l_quantity") > 45, F.col("l_returnflag") == "R"], [F.col("l_discount") == 0.1, F.col("l_linenumber") == 1]]).groupBy("l_returnflag").agg(F.count("*").alias("n")), "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE (l_quantity > 45 AND l_returnflag = 'R') OR (l_discount = 0.1 AND l_linenumber = 1) GROUP BY 1")
add("R11_added_filters", lambda c: R.select_with_filters(c.lineitem, [F.col("l_quantity") < 10, F.col("l_linestatus") == "O", F.col("l_tax") > 0.02]).groupBy("l_linenumber").agg(F.count("*").alias("n")), "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity < 10 AND l_linestatus = 'O' AND l_tax > 0.02 GROUP BY 1")
add("R12_derive_attached", lambda c: R.derive_attached(c.bibs.where("status_code = 'P'"), c.items, "bib_num").select("item_id"), "SELECT item_id FROM f_items WHERE bib_num IN (SELECT bib_num FROM f_bibs WHERE status_code = 'P')")


def _r13(c):
    docs = c.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Country").alias("type"), "n_name").toDF("id", "type", "label")
    new = c.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("Area").alias("type"), F.col("r_name").alias("label"))
    return R.load_codes(docs, {"Area": new, "Country": docs.where("id <> 'n3'"), "Unknown": docs.where("false")})


add("R13_load_codes", _r13, "SELECT 'n' || n_nationkey AS id, 'Country' AS type, n_name AS label FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'r' || r_regionkey, 'Area', r_name FROM region")
add("R15_key_ranges", lambda c: R.key_ranges(c.orders, "o_orderkey", 300), "SELECT CAST((rn - 1) // 300 AS BIGINT) AS range_no, min(k) AS first_key, max(k) AS last_key, count(*) AS n FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1")


def _r16(c):
    t = {"orders": c.orders, "customer": c.customer, "nation": c.nation, "lineitem": c.lineitem, "part": c.part}
    roots = {"orders": c.orders.where("o_orderstatus = 'P'")}
    chains = [[("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")], [("orders", "o_orderkey", "lineitem", "l_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey")]]
    found = R.harvest(roots, chains, t, {"orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "part": ["p_partkey"]})
    out = None
    for name, id_col in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("nation", "n_nationkey"), ("lineitem", "l_orderkey"), ("part", "p_partkey")):
        number = F.col("l_linenumber") if name == "lineitem" else F.lit(0)
        part = found[name].select(F.lit(name).alias("table_name"), F.col(id_col).cast("long").alias("id"), number.cast("int").alias("number"))
        out = part if out is None else out.unionByName(part)
    return out


add("R16_harvest", _r16, """
WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), cu AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)),
li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'orders' AS table_name, o_orderkey AS id, 0 AS number FROM o UNION ALL SELECT 'customer', c_custkey, 0 FROM cu
UNION ALL SELECT 'nation', n_nationkey, 0 FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM cu)
UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber FROM li
UNION ALL SELECT 'part', p_partkey, 0 FROM part WHERE p_partkey IN (SELECT l_partkey FROM li)""")
reg.also("R16_harvest_whole", "R16_harvest")


#: Orders of an order's customer, parts that share a supplier's items: relations in a circle.
_CIRCLE = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]


def _r16_closed(c):
    t = {"orders": c.orders, "customer": c.customer, "nation": c.nation, "region": c.region}
    keys = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"]}
    found = R.closed_sample({"orders": c.orders.where("o_orderkey % 50 = 7")}, _CIRCLE, t, keys)
    return reduce(lambda a, b: a.unionByName(b), [found[n].select(F.lit(n).alias("table_name"), F.col(k[0]).cast("long").alias("id")) for n, k in keys.items()])


add("R16_closed_sample", _r16_closed, """
WITH cu AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 7)), na AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM cu))
SELECT 'orders' AS table_name, o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM cu) OR o_orderkey % 50 = 7 UNION ALL SELECT 'customer', c_custkey FROM cu UNION ALL SELECT 'nation', n_nationkey FROM na
UNION ALL SELECT 'region', r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM na)""")

# --- conditions -----------------------------------------------------------------

LINES = {"flag": P.Field("l_returnflag"), "quantity": P.Field("l_quantity", "float"), "number": P.Field("l_linenumber", "int"), "order": P.Field("l_orderkey", "int")}
PARTS = {"name": P.Field("p_name"), "kind": P.Field("p_type"), "brand": P.Field("p_brand"), "size": P.Field("p_size", "int"), "words": P.Field("p_name", "text")}
ITEMS = {"number": P.Field("call_number", prepare=K.search_key), "search": P.Field("call_number_search", prepare=K.search_key), "volume": P.Field("volume"), "flags": P.Field("flags", multi=True), "place": P.Field("location_code"), "type": P.Field("type")}


def _lines(*conditions):
    return lambda c: P.apply_filters(c.lineitem, conditions, LINES).groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"))


def _lines_sql(where):
    return f"SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem WHERE {where} GROUP BY ALL"


def _parts(*conditions):
    return lambda c: P.apply_filters(c.part, conditions, PARTS).select("p_partkey", "p_name")


def _parts_sql(where):
    return f"SELECT p_partkey, p_name FROM part WHERE {where}"


add("P1_exact", _lines(("flag", "exact", False, "R"), ("number", "exact", False, "2")), _lines_sql("l_returnflag = 'R' AND l_linenumber = 2"))
add("P1_exact_text", _parts(("words", "exact", False, "Large Bolt")), _parts_sql("' ' || lower(p_name) || ' ' LIKE '% large bolt %'"))
add("P2_in", _lines(("number", "in", False, [1, 3, 5])), _lines_sql("l_linenumber IN (1, 3, 5)"))
add("P3_gt", _lines(("quantity", "gt", False, 30)), _lines_sql("l_quantity > 30"))
add("P4_gte", _lines(("quantity", "gte", False, 30)), _lines_sql("l_quantity >= 30"))
add("P5_lt", _lines(("quantity", "lt", False, "7.5")), _lines_sql("l_quantity < 7.5"))
add("P6_lte", _lines(("flag", "lte", False, "N")), _lines_sql("l_returnflag <= 'N'"))
add("P7_range", lambda c: P.apply_filters(c.orders, [("price", "range", False, [1000, 20000])], {"price": P.Field("o_totalprice", "float")}).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000")
add("P8_contains", _parts(("name", "contains", False, "d wid")), _parts_sql("contains(p_name, 'd wid')"))
add("P8_contains_text", _parts(("words", "contains", False, "OL")), _parts_sql("len(list_filter(string_split(lower(p_name), ' '), lambda w: contains(w, 'ol'))) > 0"))
add("P9_startswith", _parts(("words", "startswith", False, "bo")), _parts_sql("len(list_filter(string_split(lower(p_name), ' '), lambda w: starts_with(w, 'bo'))) > 0"))
add("P10_endswith", _parts(("brand", "endswith", False, "3"), ("size", "endswith", True, "3")), _parts_sql("suffix(p_brand, '3')"))
add("P11_matches", _parts(("kind", "matches", False, "^[EP].*O"), ("size", "matches", True, "1")), _parts_sql("regexp_matches(p_type, '^[EP].*O')"))


def _flagged(c):
    items = c.items.withColumn("call_number_search", K.search_key(F.col("call_number")))
    return items.withColumn("flags", F.when(F.col("copy_number") > 4, F.lit(None)).otherwise(F.array("status_code", F.when(F.col("copy_number") == 2, "x").otherwise("y"))))


_FLAGGED = "SELECT *, regexp_replace(upper(call_number), '[\\s./,?-]', '', 'g') AS call_number_search, CASE WHEN copy_number > 4 THEN NULL ELSE [status_code, CASE WHEN copy_number = 2 THEN 'x' ELSE 'y' END] END AS flags FROM f_items"


def _items(*conditions):
    return lambda c: P.apply_filters(_flagged(c), conditions, ITEMS).select("item_id")


def _items_sql(where):
    return f"SELECT item_id FROM ({_FLAGGED}) WHERE {where}"


add("P12_isnull", _items(("volume", "isnull", False, "true"), ("number", "isnull", False, "false")), _items_sql("volume IS NULL AND call_number IS NOT NULL"))
DOCS = {"text": P.Field("text", "text")}
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
add("P13_keywords", lambda c: P.apply_filters(c.documents, [("text", "keywords", False, 'worthless OR "the and" AND idiot NOT disgusting')], DOCS).select("doc_id"), f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' AS t FROM documents) WHERE (contains(t, ' worthless ') OR (contains(t, ' the and ') AND contains(t, ' idiot '))) AND NOT contains(t, ' disgusting ')")
add("P14_negation", _items(("volume", "endswith", True, "1"), ("volume", "isnull", True, True)), _items_sql("NOT coalesce(suffix(volume, '1'), false) AND volume IS NOT NULL"))
add("P15_any_match", _items(("flags", "exact", False, "x"), ("flags", "in", True, ["R"])), _items_sql("coalesce(list_contains(flags, 'x'), false) AND NOT coalesce(list_contains(flags, 'R'), false)"))
add("P16_call_number", _items(("search", "startswith", False, "promo 1.")), _items_sql("coalesce(starts_with(call_number_search, 'PROMO1'), false)"))
add("P17_base_filter", lambda c: _items(("type", "exact", False, "Item"), ("place", "exact", False, c.busiest(1)[0]))(c), _items_sql(f"location_code IN {busiest_sql(1)}"))
add("P18_exclude", lambda c: P.exclude(c.lineitem, [("flag", "exact", False, "R"), ("quantity", "gt", False, 10)], LINES).groupBy("l_linenumber").agg(F.count("*").alias("n")), "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity <= 10 GROUP BY 1")

# --- projections ------------------------------------------------------------------

add("J1_only", lambda c: J.only(c.items, "item_id", "copy_number"), "SELECT item_id, copy_number FROM f_items")
add("J2_camelize", lambda c: J.camelize(c.locations.withColumnRenamed("label", "_version_of_label")), 'SELECT location_num AS "locationNum", location_code AS "locationCode", label AS "_versionOfLabel", region_num AS "regionNum" FROM f_locations')
add("J3_present", lambda c: J.present(c.events.select("event_id", "value", "props"), {"value": "int", "props": "json:k int"}).select("event_id", "value", F.col("props.k").alias("k")), "SELECT event_id, CAST(trunc(value) AS INT) AS value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
add("J4_cat_fields", lambda c: J.cat_fields(_flagged(c).select("item_id", "volume", "flags", "location_code"), exclude=["item_id"]).select("item_id", "text"), f"SELECT item_id, concat_ws(' ', volume, array_to_string(flags, ' '), location_code) AS text FROM ({_FLAGGED})")
_DIGIT = "CAST((" + " + ".join(f"(o_orderkey // {10**i}) % 10 * {i + 2}" for i in range(7)) + ") % 11 AS INT)"
add("J5_record_id", lambda c: c.orders.select("o_orderkey", J.record_id(F.lit("b"), F.col("o_orderkey"), True).alias("id")), f"SELECT o_orderkey, 'b' || o_orderkey || CASE WHEN {_DIGIT} = 10 THEN 'x' ELSE CAST({_DIGIT} AS VARCHAR) END AS id FROM orders")
add("J6_suppressed", lambda c: c.items.join(c.bibs.select("bib_num", F.col("deleted_date").isNotNull().alias("hidden")), "bib_num", "left").select("item_id", J.suppressed(F.when(F.col("status_code") == "N", "-").otherwise(F.col("status_code")), F.col("hidden")).alias("suppressed")), "SELECT item_id, i.status_code <> 'N' OR b.deleted_date IS NOT NULL AS suppressed FROM f_items i LEFT JOIN f_bibs b USING (bib_num)")


def _j7(c):
    due = c.events.groupBy((F.col("event_id") % 5000).alias("bib_num")).agg(F.max("ts").alias("due"))
    labels = c.locations.select(F.substring("label", 1, 1).alias("status_code"), "label").groupBy("status_code").agg(F.min("label").alias("status_label"))
    code = F.when(F.col("copy_number") == 1, "-").otherwise(F.col("status_code"))
    return c.items.join(due, "bib_num", "left").withColumn("status_code", code).join(labels, "status_code", "left").select("item_id", J.item_status(F.col("status_code"), F.col("due"), F.col("status_label")).alias("status"))


add("J7_item_status", _j7, """
WITH due AS (SELECT event_id % 5000 AS bib_num, max(ts) AS due FROM events GROUP BY 1), lab AS (SELECT substr(label, 1, 1) AS status_code, min(label) AS status_label FROM f_locations GROUP BY 1)
SELECT item_id, CASE WHEN i.code = '-' AND due IS NOT NULL THEN 'CHECKED OUT' ELSE status_label END AS status
FROM (SELECT *, CASE WHEN copy_number = 1 THEN '-' ELSE status_code END AS code FROM f_items) i LEFT JOIN due USING (bib_num) LEFT JOIN lab ON lab.status_code = i.code""")
add("J8_strip_uris", lambda c: c.pages.select("page_id", J.strip_uris(F.concat(F.lit("Author "), "url", F.lit(" end"))).alias("author")), "SELECT page_id, regexp_replace('Author ' || url || ' end', '\\s+https?:\\S*', '', 'g') AS author FROM pages")
add("J9_clean_url", lambda c: c.pages.select("page_id", J.clean_url(F.concat("url", F.lit('" target="x'))).alias("url")), "SELECT page_id, url FROM pages")


def _www(c):
    return _bib_locations(c).withColumn("location_code", F.when(F.col("bib_num") % 8 == 0, F.concat("location_code", F.lit("www"))).otherwise(F.col("location_code")))


add("J10_date_added", lambda c: J.date_added(c.bibs.select("bib_num", F.col("created_ts").cast("date").cast("string").alias("made"), F.lit("2000-01-01").alias("cat")), _www(c), "bib_num", "made", "cat").select("bib_num", "date_added"), f"SELECT b.bib_num, CASE WHEN coalesce(l.online, true) THEN CAST(CAST(created_ts AS DATE) AS VARCHAR) ELSE '2000-01-01' END AS date_added FROM f_bibs b LEFT JOIN (SELECT bib_num, bool_and(bib_num % 8 = 0) AS online FROM ({_BIB_LOCATIONS}) GROUP BY 1) l USING (bib_num)")
add("J11_record_boost", lambda c: c.bibs.select("bib_num", J.record_boost(F.when(F.col("bib_num") % 6 == 0, None).otherwise(F.year("created_ts") + F.when(F.col("bib_num") % 10 == 1, 100).otherwise(0)), F.when(F.col("status_code") == "F", "-").otherwise("m"), 2024).alias("boost")), "SELECT bib_num, CAST(coalesce(CASE WHEN y <= 2029 THEN greatest(500 - (2020 - y), 1) ELSE 460 END, 460) + CASE WHEN status_code = 'F' THEN 500 ELSE 0 END AS INT) AS boost FROM (SELECT bib_num, status_code, CASE WHEN bib_num % 6 = 0 THEN NULL ELSE year(created_ts) + CASE WHEN bib_num % 10 = 1 THEN 100 ELSE 0 END END AS y FROM f_bibs)")
add("J12_alternate_titles", lambda c: c.part.select("p_partkey", F.array_join(J.alternate_titles(F.array("p_name", "p_type", "p_type"), F.array("p_brand", "p_type"), F.col("p_name")), "|").alias("titles")), "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_type, p_brand], lambda v: v <> p_name))), '|') AS titles FROM part")
add("J13_display_content", lambda c: c.varfields.select("record_num", "type_code", "occ_num", J.display_content(F.col("content"), "ab", "; ").alias("shown"), J.display_content(F.col("content"), "x", " -- ", keep=False).alias("rest")), "SELECT record_num, type_code, occ_num, regexp_replace(regexp_replace(regexp_replace(content, '\\|[^|ab][^|]*', '', 'g'), '^\\|.', ''), '\\|.', '; ', 'g') AS shown, regexp_replace(regexp_replace(regexp_replace(content, '\\|[x][^|]*', '', 'g'), '^\\|.', ''), '\\|.', ' -- ', 'g') AS rest FROM f_varfields")
add("J14_composite_key", lambda c: c.items.select(J.composite_key(["bib_num", "volume", "copy_number"]).alias("key")), "SELECT concat_ws('-', bib_num, coalesce(volume, ''), copy_number) AS key FROM f_items")
