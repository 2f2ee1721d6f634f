"""Reading source tables, writing and re-reading documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared schemas of the source tables.
SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
}


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One source table with its declared schema, so that no file is opened to infer it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def load_tables(spark: SparkSession, directory: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Several source tables by name."""
    return {n: load_table(spark, directory, n) for n in names}


def write_documents(docs: DataFrame, path: str, type_col: str = "type") -> None:
    """Documents in one folder per type."""
    docs.write.mode("overwrite").partitionBy(type_col).parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Nested records as JSON lines, one file per partition."""
    records.write.mode("overwrite").json(path)


def scan_documents(spark: SparkSession, path: str, fields: Iterable[str], key: str = "id") -> DataFrame:
    """Stored documents restricted to the key and some fields."""
    wanted = [key, *[f for f in fields if f != key]]
    return spark.read.parquet(path).select(*wanted)


def string_is_true(column) -> F.Column:
    """Import rule of flags: empty, all zeros and anything that starts with F or f are false."""
    return ~F.coalesce(column, F.lit("")).rlike("^([Ff].*|0*)$")


def rows_to_batch(df: DataFrame, flags: Mapping[str, str], map_col: str = "permissions") -> DataFrame:
    """String flag columns to one map of permission name to truth; the other columns stay."""
    pairs = [x for name, column in flags.items() for x in (F.lit(name), string_is_true(F.col(column)))]
    return df.withColumn(map_col, F.create_map(*pairs)).drop(*flags.values())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, else a warehouse that is no local folder; a temporary folder only where all run in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] == "local":
        named = tempfile.gettempdir()
    elif not named:
        named = spark.conf.get("spark.sql.warehouse.dir")
        if named.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir: the warehouse folder is on one machine's disk")
    return f"{named.rstrip('/')}/shelfwise/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch path and read back, so that what follows reads what was written whatever executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
