"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters outside the six ASCII blanks (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse.

    Only where all run in one process (a local session without that setting)
    a temporary folder stands in for it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        named = spark.conf.get("spark.sql.warehouse.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="shelfwise-")
    return _own_dir[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts the lineage in a way that outlives lost executors.
    """
    path = f"{shared_dir(df.sparkSession)}/shelfwise-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shelfwise_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "shelfwise_path", None)
        if path is not None:
            context = t.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def hot_keys(rows: DataFrame, key: str, most: int = 1_000, part: int | None = None) -> list[tuple]:
    """(key, parts): into how many parts the rows of a key are split that holds more than one ``most``-th of all rows; at most ``most`` keys.

    A part has one ``most``-th of all rows, so there are at most twice as many
    parts as ``most``; or it has ``part`` rows.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    if not total:
        return []
    large = counts.where((F.col("n") * most > total) & (F.col("n") > 100) & F.col(key).isNotNull())
    return [(r[0], r[1]) for r in large.select(key, F.ceil(F.col("n") / (part or total / most)).cast("int").alias("parts")).collect()]


def join_spread(rows: DataFrame, table: DataFrame, key: str, hot: list[tuple], how: str = "inner") -> DataFrame:
    """Rows joined to ``table`` by ``key`` without all rows of a hot key (``hot_keys``) meeting in one task.

    The rows of a hot key are dealt over its parts by a hash of their other
    columns, which a task that runs again repeats, and what the table holds of
    the key is repeated once for each part.
    """
    if not hot:
        return rows.join(table, key, how)
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    schema = T.StructType([T.StructField("_hot", kind), T.StructField("_parts", T.IntegerType())])
    parts = F.broadcast(spark.createDataFrame(hot, schema))  # a bounded number of keys
    n = F.coalesce("_parts", F.lit(1))
    own = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != key] or [F.col(key)])
    dealt = rows.join(parts, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.pmod(own, n).cast("int")).drop("_hot", "_parts")
    repeated = table.join(parts, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_hot", "_parts")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_class(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus)).cast("int")
