"""Catalogue-shaped views over the test tables, as SQL that Spark and DuckDB read alike.

Names in braces are source tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load_table

VIEWS: dict[str, str] = {
    "f_locations": """
SELECT n_nationkey AS location_num, lower(substr(n_name, 1, 3)) || CAST(n_nationkey AS VARCHAR(3)) AS location_code,
       n_name AS label, n_regionkey AS region_num
FROM {nation}""",
    "f_bibs": """
SELECT o_orderkey AS bib_num, 'b' AS record_type, o_orderdate AS created_ts,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS updated_ts,
       CASE WHEN o_orderkey % 29 = 0 THEN CAST(o_orderdate AS DATE) END AS deleted_date,
       o_orderstatus AS status_code, o_orderpriority AS priority, o_custkey AS resource_num,
       CASE WHEN o_orderkey % 5 = 0 THEN '19uu' WHEN o_orderkey % 3 = 0 THEN '199u'
            ELSE CAST(year(o_orderdate) AS VARCHAR(4)) END AS date1
FROM {orders}""",
    "f_items": """
SELECT concat_ws('-', l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, CAST(l.l_shipdate AS DATE)) AS item_id,
       l.l_orderkey AS bib_num, 'Item' AS type, f.location_code AS location_code,
       CASE WHEN l.l_partkey % 13 = 0 THEN NULL
            ELSE p.p_type || ' ' || CAST(p.p_size AS VARCHAR(9)) || '.' || substr(p.p_brand, 7) || ' .' ||
                 upper(substr(p.p_name, 1, 1)) || CAST(p.p_partkey AS VARCHAR(9)) END AS call_number,
       CASE WHEN l.l_partkey % 10 < 5 THEN 'lc' WHEN l.l_partkey % 10 < 7 THEN 'sudoc'
            WHEN l.l_partkey % 10 < 8 THEN 'dewey' ELSE 'other' END AS call_number_type,
       CASE WHEN l.l_orderkey % 4 = 0 THEN 'Vol. ' || CAST(CAST(l.l_quantity AS INT) AS VARCHAR(9)) END AS volume,
       l.l_linenumber AS copy_number, l.l_returnflag AS status_code, p.p_size AS item_type_code,
       l.l_shipdate AS updated_ts,
       CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN CAST(l.l_shipdate AS DATE) END AS deleted_date,
       CASE WHEN l.l_linenumber % 2 = 0 THEN l.l_linenumber END AS display_order,
       l.l_extendedprice AS price
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
     JOIN f_locations f ON s.s_nationkey = f.location_num""",
    "f_varfields": """
SELECT p_partkey AS record_num, 'c' AS type_code, CASE WHEN p_partkey % 3 = 0 THEN '099' ELSE '050' END AS marc_tag,
       0 AS occ_num, '|a' || p_brand || '|b' || CAST(p_size AS VARCHAR(9)) AS content FROM {part}
UNION ALL
SELECT p_partkey, 't', '245', 0, '|a' || p_name || '|c' || p_type FROM {part}
UNION ALL
SELECT p_partkey, 'd', '650', 0, '|a' || p_type || '|x' || p_brand || '|y199' || CAST(p_size % 10 AS VARCHAR(1)) FROM {part}
UNION ALL
SELECT p_partkey, 'd', '650', 1, '|a' || p_name || '|z' || p_type FROM {part} WHERE p_partkey % 2 = 0
UNION ALL
SELECT p_partkey, 'x', CAST(NULL AS VARCHAR(3)), 0, p_brand FROM {part} WHERE p_partkey % 4 = 0""",
    "f_busy": """
SELECT location_code, row_number() OVER (ORDER BY n DESC, location_code) AS place
FROM (SELECT f.location_code, count(*) AS n
      FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN f_locations f ON s.s_nationkey = f.location_num
      GROUP BY f.location_code) b""",
    "f_events": "SELECT event_id, user_id AS record_num, ts AS updated_ts, event_type AS status_code, value, props FROM {events}",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")


def busiest_sql(n: int) -> str:
    """SQL of the codes that ``Catalogue.busiest`` gives."""
    return f"(SELECT location_code FROM f_busy WHERE place <= {n})"


def prelude(sql: str) -> str:
    """WITH clauses of the views that ``sql`` names, and of those that these name."""
    names: list[str] = []

    def add(text: str) -> None:
        for n in VIEWS:
            if re.search(rf"\b{n}\b", text) and n not in names:
                add(VIEWS[n])
                names.append(n)

    add(sql)
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def duckdb_sql(sql: str) -> str:
    """``sql`` with its views spelled out; a WITH clause of its own is merged."""
    head = prelude(sql).replace("{", "").replace("}", "")
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[4:].lstrip()}" if re.match(r"with\b", body, re.I) else f"WITH {head} {body}"


class Catalogue:
    """The source tables and views of one folder, as attributes; each is read when it is asked for."""

    def __init__(self, spark: SparkSession, directory: str):
        self._spark, self._directory = spark, directory

    def busiest(self, n: int) -> list[str]:
        """Codes of the ``n`` locations with most items."""
        return [r["location_code"] for r in self.busy.where(F.col("place") <= n).orderBy("place").collect()]

    def items_with(self, told: DataFrame) -> DataFrame:
        """The view of items with the other columns of ``told`` (bib_num, ...), null where it has no row.

        These meet the lines that items are made of, so what is shuffled by bib
        and then by part has none of the texts of an item.
        """
        lines = self.lineitem.join(told.withColumnRenamed("bib_num", "l_orderkey"), "l_orderkey", "left")
        more = "".join(f", l.{c} AS {c}" for c in told.columns if c != "bib_num")
        view = VIEWS["f_items"].replace("\nFROM {lineitem} l", f"{more}\nFROM {{lineitem}} l")
        return self._spark.sql(f"WITH f_locations AS ({VIEWS['f_locations']}) {view}", lineitem=lines, part=self.part, supplier=self.supplier, nation=self.nation)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return load_table(self._spark, self._directory, name)
        view = f"f_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        sql = f"WITH {prelude(view)} SELECT * FROM {view}"
        used = set(re.findall(r"\{(\w+)\}", sql))
        return self._spark.sql(sql, **{t: load_table(self._spark, self._directory, t) for t in used})
