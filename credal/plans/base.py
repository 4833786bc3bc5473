"""The register of queries with their SQL, and the tables that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(c, n: int = 6):
    return F.round(c, n)


def places(spark: SparkSession, d: str) -> DataFrame:
    """A tree of a root, regions and nations: id, parent, name."""
    region = table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(1).cast("long").alias("parent"), F.col("r_name").alias("name"))
    nation = table(spark, d, "nation").select((F.col("n_nationkey") + 10000).cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"), F.col("n_name").alias("name"))
    root = spark.createDataFrame([(1, None, "WORLD")], "id long, parent long, name string")
    return root.unionByName(region).unionByName(nation)


PLACES = """places AS (SELECT 1::BIGINT AS id, NULL::BIGINT AS parent, 'WORLD' AS name
    UNION ALL SELECT r_regionkey + 1000, 1, r_name FROM region UNION ALL SELECT n_nationkey + 10000, n_regionkey + 1000, n_name FROM nation)"""
