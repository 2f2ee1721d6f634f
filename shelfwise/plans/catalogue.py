"""All catalogue queries, their SQL, and the flagship query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import documents, joins, predicates, shelflist
from . import analysis_queries, document_queries, record_queries, selection_queries
from .views import Catalogue

PARTS = (selection_queries, analysis_queries, document_queries, record_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for p in PARTS for k, v in p.reg.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.reg.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 20 items of the location with most items whose call number starts with a prefix, in shelf order, with label and row number."""
    c = Catalogue(spark, sf_dir)
    items = documents.call_number_fields(c.items)
    manifest = shelflist.shelflist(items)
    fields = {"location": predicates.Field("location_code"), "number": predicates.Field("call_number_search", prepare=K.search_key)}
    found = predicates.apply_filters(items, [("location", "exact", False, c.busiest(1)[0]), ("number", "startswith", False, "promo")], fields)
    labelled = joins.with_labels(found, c.locations, "location_code", "location_code", "label", "location_label")
    numbered = labelled.join(manifest.select("item_id", "row_number"), "item_id")
    return numbered.orderBy("row_number").limit(20).select("item_id", "call_number", "location_code", "location_label", F.col("row_number"))
