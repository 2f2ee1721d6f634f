"""What only shows on larger tables: keys that meet, texts read once, tasks that stay small."""

from pyspark.sql import functions as F

from shelfwise.functions import arrays as T
from shelfwise.operators import bibs
from shelfwise.operators import documents as D
from shelfwise.operators import identifiers as I
from shelfwise.operators import search as Q
from shelfwise.operators import shelflist as W
from shelfwise.plans import catalogue, record_queries


def test_assembled_records_of_two_tables_keep_apart(spark, tmp_path):
    """Beyond a million parts a part has the number of a supplier's record."""
    part = [(1_000_001, "red nut", "Brand#11", "PROMO", 7, 1.0), (5, "old nut", "Brand#12", "LARGE", 8, 1.0)]
    spark.createDataFrame(part, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "s", 1, 0.0)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = sorted(map(tuple, catalogue.queries()["D1_assemble_records"](spark, str(tmp_path)).collect()))
    assert [r[0] for r in rows] == [5, 1_000_001, 1_000_001]
    assert rows[1][1].startswith("050=a:Brand#11;b:7^245=a:red nut;c:PROMO") and rows[2][1] == "error"


def test_long_lccn_is_padded_but_never_cut(spark):
    """As zfill of the behaviour studied."""
    df = spark.createDataFrame([("85-1000007 /AC",), ("85-7",)], "n string")
    assert [r[0] for r in df.select(I.normalized_lccn(F.col("n"))).collect()] == ["851000007", "85000007"]


TEXTS = [
    "of the in-law", "o-f the in", "of th-e in", "of, the (in)", "The of THE iN", "ofThe In it", "of\tthe's in", "Of the i-n x", None, "", "idi-ot, and more", "IDIOT's the", "worthless idiot the!", "loser Theis", "the lösér", "the-loser", "an IdiοT (αΣ) ασλ 7th the2",
    "the of idiot disgusting", "of the Idiot the disgusting", "disgusting of, the x idiot the", "αΣ the ΟΣ.x",
]


def test_questions_to_texts_answer_as_an_index_does(spark):
    """Q2 to Q5: what is not taken apart holds no answer."""
    docs = spark.createDataFrame([(i, t, (t or "")[:9]) for i, t in enumerate(TEXTS)], "id int, text string, title string")
    fields, ids = ["text"], lambda df: sorted(r["id"] for r in df.collect())
    index = Q.token_index(docs, "id", fields)
    for asked in ({"anyof": ["idiot", "loser"], "allof": ["the"], "noneof": ["worthless"]}, {"allof": ["ας"]}, {"anyof": ["(in)", "th-e"]}, {"anyof": ["the2", "inlaw", "idiots"]}, {"noneof": ["the"]}):
        assert ids(Q.keyword_filter_texts(docs, "id", fields, **asked)) == ids(Q.keyword_filter(index, "id", **asked)), asked
    for phrase, slop in ((["of", "the", "in"], 0), (["ofthe", "the"], 0), (["of", "the", "in"], 1), (["the", "inlaw"], 0), (["the", "idiot"], 1)):
        assert ids(Q.phrase_filter_texts(docs, "id", fields, phrase, slop)) == ids(Q.phrase_filter(index, "id", phrase, slop)), phrase
    found = Q.search(docs, "id", Q.keyword_filter(index, "id", anyof=["idiot"]), Q.keyword_filter(index, "id", allof=["the"]))
    assert ids(Q.search_texts(docs, "id", fields, {"anyof": ["idiot"]}, {"allof": ["the"]})) == ids(found) != []
    both, query = Q.token_index(docs, "id", ["text", "title"]), ["of", "the", "idiot", "the", "disgusting"]
    weights = {"title": 10.0, "text": 2.0}
    want = sorted(map(tuple, Q.ranked_search(both, "id", query, 21, weights, 1, weights).collect()))
    assert sorted(map(tuple, Q.ranked_search_texts(docs, "id", query, 21, weights, 1, weights).collect())) == want and len(want) > 10


def test_questions_shuffle_no_positions_but_those_of_their_words(spark):
    docs = spark.createDataFrame([(1, "a b c")], "id int, text string")
    plan = Q.keyword_filter_texts(docs, "id", ["text"], anyof=["zzz"])
    assert plan.count() == 0 and Q.text_index(docs, "id", ["text"], ["c"]).collect() == [(1, "text", 2, "c")]


def test_grouped_fields_are_not_shuffled(spark):
    """T5: each group of a field once, without a table of whole fields in memory."""
    groups = spark.createDataFrame([("tag", "245", "a"), ("tag", "245", "a"), ("type", "t", "a"), ("type", "t", "b"), ("tag", "650", "c")], "match string, code string, `group` string")
    fields = spark.createDataFrame([(1, "t", "245"), (2, "t", None), (3, "x", "650"), (4, "x", None)], "n int, type_code string, marc_tag string")
    df = T.group_fields(fields, groups)
    assert sorted((r["group"], r["n"]) for r in df.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 3)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("broadcast") == 2 and "Aggregate [group" not in plan  # before: all rows told apart by all their columns


def test_ranked_rows_hold_only_what_is_asked_for(spark):
    """Sort columns are not stored behind the sort."""
    items = spark.createDataFrame([(f"i{i}", f"l{i % 2}", f"k{9 - i}") for i in range(10)], "item_id string, location_code string, call_number_sort string")
    items = items.withColumns({c: F.lit(None).cast("string") for c in W.SHELF_ORDER if c not in items.columns})
    listed = W.shelflist(items)
    assert sorted(map(tuple, listed.collect())) == [(f"l{n}", i, f"i{8 + n - 2 * i}") for n in (0, 1) for i in range(5)]
    assert "call_number_sort" not in listed._jdf.queryExecution().analyzed().toString()
    placed = W.ordered_with_position(items, ["-call_number_sort"], tie="item_id", keep=["item_id"])
    assert placed.columns == ["item_id", "position"] and {r["item_id"]: r["position"] for r in placed.collect()} == {f"i{i}": i for i in range(10)}


def test_items_meet_fields_bibs_and_checkouts_in_one_shuffle(spark):
    """Fields and checkouts that name the bib give the same documents as those that do not, with one shuffle of items."""
    items = spark.createDataFrame([("i1", 1, "QA 1", "lc"), ("i2", 1, None, None), ("i3", None, "QB 2", "lc"), ("i4", 9, None, "lc"), (None, 1, None, None), ("i5", 2, None, None), ("i5", 2, "twice", "other")], "item_id string, bib_num long, call_number string, call_number_type string")
    items = items.select("*", F.lit("-").alias("item_code"), F.lit(3).alias("item_type_code"), F.lit("w").alias("location_code"))
    bibs = spark.createDataFrame([(1, "b1", "X 7", "lc", "T", "A", 2000, False), (2, "b2", None, None, "U", "B", 2001, True), (None, "b0", "no", "lc", "V", "C", 1, False)], "bib_num long, bib_id string, call_number string, call_number_type string, title string, author string, year int, suppressed boolean")
    told = [("i1", 1, "x", 1, "x1"), ("i1", 1, "n", 0, "n0"), ("i1", 1, "x", 0, "x0"), ("i1", 1, "v", 1, "v.2"), ("i1", 1, "v", 0, "v.1"), ("i1", 1, "q", 0, "?"), ("i3", None, "b", 0, "99"), ("i3", None, "m", 0, None), ("i5", 2, "p", 0, "p"), (None, 1, "b", 0, "lost"), ("i7", 1, "b", 0, "no item")]
    fields = spark.createDataFrame(told, "item_id string, bib_num long, type_code string, occ_num int, content string")
    checkouts = spark.createDataFrame([("i2", 1, "2024-01-01"), ("i3", None, "2024-02-02")], "item_id string, bib_num long, due_date string").withColumns({c: F.lit(None).cast("string") for c in ("checkout_date", "overdue_date", "recall_date")})
    near = D.item_documents(items, fields, bibs, checkouts)
    apart = D.item_documents(items, D.item_fields(fields.drop("bib_num"), "item_id"), bibs, checkouts.drop("bib_num"))
    assert set(near.columns) == set(apart.columns)
    rows = lambda df: sorted(map(repr, df.select(*sorted(apart.columns)).collect()))
    assert rows(near) == rows(apart) and near.count() == 7
    one = near.where("item_id = 'i1'").first()
    assert (one["volume"], one["internal_notes"], one["call_number_sort"]) == ("v.1", ["x0", "x1", "n0"], "QA!0000000001")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = D.item_documents(items, fields, bibs, checkouts)._jdf.queryExecution().sparkPlan()
        initial = near.sparkSession._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(near.sparkSession._jsparkSession, plan).toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert initial.count("Exchange hashpartitioning") == 2  # rows of items, fields and checkouts; bibs


def test_bib_documents_take_more_tasks_for_more_records(spark, tmp_path):
    """What one task puts together does not grow with the table."""
    part = spark.range(100_000).select(F.col("id").alias("p_partkey"), F.lit("nut").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    dealt = []
    together = record_queries.spread
    try:
        record_queries.spread = lambda df, key: dealt.append(together(df, key)) or dealt[0].limit(0)
        catalogue.queries()["D27_bib_documents"](spark, str(tmp_path))
    finally:
        record_queries.spread = together
    each = [r["count"] for r in dealt[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == 100_000 and max(each) < 1.1 * record_queries.TOGETHER  # before: 6,250 a task, 450,000 of 7.2 million
    assert together(spark.range(100).toDF("k"), "k").rdd.getNumPartitions() == 16


def test_items_that_hold_what_they_are_told_are_not_shuffled_with_it(spark):
    """Fields, checkouts and bibs told from an item's own columns give the same documents as tables of them."""
    items = spark.createDataFrame([("i1", 1, "QA 1", "lc", "v.1", "x1"), ("i2", 1, None, None, None, None), ("i3", None, "QB 2", "lc", "v.3", "x3"), ("i4", 9, None, "lc", None, "x4"), ("i5", 2, None, None, "v.5", None)], "item_id string, bib_num long, call_number string, call_number_type string, vol string, note string")
    items = items.select("*", F.lit("-").alias("item_code"), F.lit(3).alias("item_type_code"), F.lit("w").alias("location_code"))
    bibs = spark.createDataFrame([(1, "b1", "X 7", "lc", "T", "A", 2000, False), (2, "b2", None, None, "U", "B", 2001, True)], "bib_num long, bib_id string, call_number string, call_number_type string, title string, author string, year int, suppressed boolean")
    field = lambda code, n, text: F.when(text.isNotNull(), F.struct(F.lit(code).alias("type_code"), F.lit(n).alias("occ_num"), text.alias("content")))
    fields = F.filter(F.array(field("v", 0, F.col("vol")), field("n", 0, F.lit("n0")), field("x", 1, F.col("note")), field("x", 0, F.lit("x0")), field("q", 0, F.lit("?"))), lambda f: f.isNotNull())
    lent = F.when(F.col("vol") == "v.5", F.struct(F.lit("2024-01-01").alias("due_date"), *[F.lit(None).cast("string").alias(c) for c in ("checkout_date", "overdue_date", "recall_date")]))
    told = items.select("item_id", F.explode(fields).alias("f")).select("item_id", "f.*")
    want = D.item_documents(items, D.item_fields(told, "item_id"), bibs, items.select("item_id", lent.alias("l")).where("l IS NOT NULL").select("item_id", "l.*"))
    near = D.item_documents(items, fields, bibs, lent)
    held = items.join(bibs.select("bib_num", F.struct(*bibs.columns[1:]).alias("own")), "bib_num", "left")
    rows = lambda df: sorted(map(repr, df.select(*sorted(want.columns)).collect()))
    assert rows(near) == rows(want) == rows(D.item_documents(held, fields, F.col("own"), lent).drop("own")) and near.count() == 5
    assert near.where("item_id = 'i1'").first()["internal_notes"] == ["x0", "x1", "n0"]


def test_item_documents_shuffle_lines_before_texts_are_made(spark):
    """Lines meet orders, then parts; no further table is shuffled or stored for what is told from an item's own columns."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.queries()["D5_item_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan()
        initial = spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(spark._jsparkSession, plan).toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Generate explode" not in initial and "ggregate" not in initial and "lineitem.parquet" in initial  # before: rows of items, fields and checkouts met, read from a stored table of items
    by_bib, by_part = (initial.index(f"hashpartitioning({k}") for k in ("l_orderkey", "l_partkey"))
    assert 0 < initial.index("concat_ws(-") < min(by_bib, by_part)  # texts stand above all shuffles of lines


def _broadcast(node):
    """Trees of what a plan broadcasts."""
    if node.nodeName() == "BroadcastExchange":
        yield node.treeString()
    for i in range(node.children().size()):
        yield from _broadcast(node.children().apply(i))


def test_tables_of_records_are_never_gathered_on_the_driver(spark, monkeypatch):
    """Spark tells a table's size by its file, a few MB for millions of records; what is as long as the table of records meets in tasks."""
    met = []
    monkeypatch.setattr(bibs, "stored", lambda df, name: met.append(df) or df.limit(0))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        catalogue.queries()["D27_bib_documents"](spark, "/root/testdata/sf0.001")
        gathered = [t for t in _broadcast(met[0]._jdf.queryExecution().executedPlan()) if "FileScan" in t or "Exchange hashpartitioning" in t]
        links = D.linked_works(*[spark.range(9).select(F.col("id").alias("k"), F.lit("a").alias("t"), F.lit("g").alias("g"), F.lit(0).alias("p"), F.lit("a").alias("work_key"))] * 2, "k", "t", "g", "p", ("g",))
        assert not list(_broadcast(links._jdf.queryExecution().executedPlan())) and links.count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert gathered == []  # before: names, works, items, places of all records
