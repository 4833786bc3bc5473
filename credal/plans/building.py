"""Registered queries of building an index and of looking things up in it, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credal.functions import dates
from credal.operators import building, hierarchy
from credal.plans import matcher, resolver
from credal.plans.base import PLACES, places, query, rounded, table
from credal.plans.network import Network


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderdate::DATE AS given, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE
        WHEN 2 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) END AS day FROM orders)
    SELECT id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN day IS NOT NULL THEN round(greatest(0, 1 - abs(date_diff('day', day, given + (id % 40)::INT)) / 30.0), 6) END::DOUBLE AS likeness FROM t""")
def order_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates read from three forms (and two texts that are none), against a date some days later."""
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("date")
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "MMM d, yyyy")).when(k == 2, F.date_format(day, "M/d/yy")).when(k == 3, "some day").otherwise(" ")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), dates.date_of(text).alias("day"), F.date_add(day, (F.col("o_orderkey") % 40).cast("int")).alias("other"))
    return rows.select("id", dates.date_text(F.col("day")).alias("day"), rounded(dates.date_likeness(F.col("day"), F.col("other"))).alias("likeness"))


@query(f"""WITH {PLACES} SELECT id::VARCHAR AS id, CASE WHEN parent IS NULL THEN 'isRoot' ELSE '' END AS marks, name FROM places
    UNION ALL SELECT (20000 + s_suppkey)::VARCHAR, CASE WHEN s_suppkey % 2 = 0 THEN 'isSynonym' ELSE '' END, 'supplier' FROM supplier WHERE s_suppkey % 2 = 0""")
def built_records(spark: SparkSession, d: str) -> DataFrame:
    """Two sources loaded, marked and expanded: the place tree, and suppliers that are synonyms of nations or orphans below a missing place."""
    s = F.col("s_suppkey")
    other = table(spark, d, "supplier").select((20000 + s).cast("long").alias("id"), F.when(s % 2 == 1, F.lit(-1).cast("long")).alias("parent"), F.when(s % 2 == 0, (F.col("s_nationkey") + 10000).cast("long")).alias("accepted"), F.lit("supplier").alias("name"))
    rows = building.annotated(building.loaded([places(spark, d), other]), "id", F.struct("id", "name"), "parent", "accepted")
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("parent", "accepted")})
    return building.expanded(rows, "id", "parent", "accepted").select("id", F.array_join("annotations", ",").alias("marks"), "name")


@query("""WITH w AS (SELECT c_nationkey AS taxon, c_mktsegment AS name, max(c_acctbal) AS w FROM customer GROUP BY 1, 2)
    SELECT taxon, string_agg(name, ',' ORDER BY w DESC, name) AS names FROM w GROUP BY 1""")
def ranked_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of each nation by weight, each once."""
    found = building.common_names(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal")
    return found.select(F.col("c_nationkey").alias("taxon"), F.array_join("names", ",").alias("names"))


@query(f"""WITH {PLACES} SELECT p.id, CASE WHEN p.parent IS NULL THEN '1' WHEN p.parent = 1 THEN '1,' || p.id ELSE '1,' || p.parent || ',' || p.id END || CASE WHEN p.id >= 10000 THEN ',x' ELSE '' END AS ids FROM places p""")
def place_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """All ids by which a place may be asked for; nations stand for a record "x"."""
    t = hierarchy.trails(places(spark, d), "id", "parent")
    accepted = F.when(F.col("id") >= 10000, "x").otherwise(F.col("id").cast("string"))
    return t.select("id", F.array_join(building.identifiers(F.col("trail"), accepted), ",").alias("ids"))


_PLACES = resolver.Model(Network("places", ["id", "name", "rank"], [("id", "name"), ("id", "rank")]), "id")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE lower(r_name) END AS estimated FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def estimated_regions(spark: SparkSession, d: str) -> DataFrame:
    """The region of what customers give: a nation, an unknown nation with a region, both, or nothing that is known."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("rank"), F.lower("r_name").alias("part"))
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("rank"), F.lower("r_name").alias("part"))
    index = resolver.build(_PLACES, nations.unionByName(regions).withColumn("weight", F.lit(1.0)))
    k = F.col("c_custkey") % 4
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("c_custkey").alias("id"), F.when(k.isin(0, 2), F.col("n_name")).otherwise("Nowhere").alias("country"), F.when(k.isin(1, 2), F.col("r_name")).alias("area"), F.lit(None).cast("string").alias("part"))
    return matcher.estimated(matcher.Control(_PLACES), index, rows, "id", [("country", "nation"), ("area", "region")], "name", "rank", "part").select("id", "estimated")
