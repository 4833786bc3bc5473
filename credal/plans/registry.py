"""The registered queries of the record-resolution engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credal.functions import strings as S
from credal.operators import conditions, hierarchy, matching, parameters
from credal.plans import matcher, resolver
from credal.plans import building, taxa  # noqa: F401  (they register their queries)
from credal.plans.base import PLACES as _PLACES, QUERIES as _QUERIES, SQL as _SQL, places as _places, query as _query, rounded as _r, table as _t
from credal.plans.network import Network
from credal.plans.resolver import Model
from credal.sources import archive

@_query(f"""WITH {_PLACES}, t AS (
    SELECT id, '1' AS trail, 0 AS depth, '1' AS k FROM places WHERE parent IS NULL
    UNION ALL SELECT id, '1/' || id, 1, '1/' || lpad(id::VARCHAR, 20, '0') FROM places WHERE parent = 1
    UNION ALL SELECT p.id, '1/' || p.parent || '/' || p.id, 2, '1/' || lpad(p.parent::VARCHAR, 20, '0') || '/' || lpad(p.id::VARCHAR, 20, '0') FROM places p WHERE p.parent >= 1000)
    SELECT id, trail, depth, row_number() OVER (ORDER BY k || '/~')::BIGINT AS "right",
        row_number() OVER (ORDER BY k || '/~')::BIGINT - (SELECT count(*) FROM t u WHERE u.trail = t.trail OR starts_with(u.trail, t.trail || '/'))::BIGINT + 1 AS "left" FROM t""")
def tree_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Nested-set numbers and trails of the place tree."""
    out = hierarchy.numbering(hierarchy.trails(_places(spark, d), "id", "parent"))
    return out.select("id", F.array_join(F.transform("trail", lambda x: x.cast("string")), "/").alias("trail"), "depth", "left", "right")


@_query("""SELECT c_mktsegment AS segment, round(sum(abs(c_acctbal)), 2) AS weight,
    round(sum(abs(c_acctbal)) / (SELECT sum(abs(c_acctbal)) FROM customer), 6) AS prior FROM customer GROUP BY 1""")
def weighted_priors(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.abs("c_acctbal").alias("w"))
    return parameters.priors(rows, "segment", "w").select("segment", _r("weight", 2).alias("weight"), _r("prior").alias("prior"))


_CONDITIONAL = """SELECT n, s, bth / nullif(gn, 0) AS p_t, (gs - bth) / nullif(total - gn, 0) AS p_f, gs / total AS prior FROM (
    SELECT c_nationkey AS n, c_mktsegment AS s, sum(abs(c_acctbal)) AS bth,
        sum(sum(abs(c_acctbal))) OVER (PARTITION BY c_nationkey) AS gn, sum(sum(abs(c_acctbal))) OVER (PARTITION BY c_mktsegment) AS gs,
        sum(sum(abs(c_acctbal))) OVER () AS total FROM customer GROUP BY 1, 2)"""


@_query(f"SELECT s AS segment, n AS nation, round(p_t, 6) AS p_t, round(p_f, 6) AS p_f FROM ({_CONDITIONAL})")
def conditional_parameters(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.abs("c_acctbal").alias("w"))
    return parameters.conditionals(rows, "segment", ["nation"], "w").select("segment", "nation", _r("p_t").alias("p_t"), _r("p_f").alias("p_f"))


def _nation_matches(spark: SparkSession, d: str) -> DataFrame:
    """For every segment as a template, the posterior of every nation that has it."""
    rows = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.abs("c_acctbal").alias("w"))
    p = parameters.conditionals(rows, "segment", ["nation"], "w").join(parameters.priors(rows, "nation", "w").drop("weight"), "nation")
    return p.select("segment", "nation", "prior", *[c.alias(k) for k, c in parameters.posterior(F.col("prior"), F.col("p_t"), F.col("p_f"), F.lit(True)).items()])


_MATCHES = """m AS (SELECT s AS segment, n AS nation, gn / total AS prior, bth / gn AS p_t, (gs - bth) / (total - gn) AS p_f FROM (
    SELECT c_nationkey AS n, c_mktsegment AS s, sum(abs(c_acctbal)) AS bth, sum(sum(abs(c_acctbal))) OVER (PARTITION BY c_nationkey) AS gn,
        sum(sum(abs(c_acctbal))) OVER (PARTITION BY c_mktsegment) AS gs, sum(sum(abs(c_acctbal))) OVER () AS total FROM customer GROUP BY 1, 2)),
    e AS (SELECT *, p_t * prior + p_f * (1 - prior) AS evidence FROM m)"""


@_query(f"WITH {_MATCHES} SELECT segment, nation, round(prior, 6) AS prior, round(evidence, 6) AS evidence, round(p_t, 6) AS conditional, round(p_t * prior / evidence, 6) AS posterior, round(p_t / evidence, 6) AS boost FROM e")
def posteriors(spark: SparkSession, d: str) -> DataFrame:
    return _nation_matches(spark, d).select("segment", "nation", *[_r(c).alias(c) for c in ("prior", "evidence", "conditional", "posterior", "boost")])


@_query(f"""WITH {_MATCHES} SELECT segment, CASE WHEN max(p_t * prior / evidence) >= 0.99 THEN 'immediate'
    WHEN sum(CASE WHEN p_t * prior / evidence >= 0.9 AND evidence >= 1e-8 AND p_t >= 0.05 THEN 1 ELSE 0 END) = 1 THEN 'single'
    WHEN sum(CASE WHEN p_t * prior / evidence >= 0.9 AND evidence >= 1e-8 AND p_t >= 0.05 THEN 1 ELSE 0 END) > 1 THEN 'ambiguous' ELSE 'none' END AS outcome,
    sum(CASE WHEN prior > 20 * evidence OR prior > p_t THEN 1 ELSE 0 END)::BIGINT AS bad FROM e GROUP BY segment""")
def match_decisions(spark: SparkSession, d: str) -> DataFrame:
    m = _nation_matches(spark, d)
    bad = m.groupBy("segment").agg(F.sum(F.when(matching.bad_evidence(F.col("prior"), F.col("evidence"), F.col("conditional")), 1).otherwise(0)).alias("bad"))
    return matching.single(m, "segment", "nation").select("segment", "outcome").join(bad, "segment")


@_query("""WITH p AS (SELECT p_partkey AS k, unnest([['brand', lower(p_brand)], ['type', lower(p_type)], ['size', p_size::VARCHAR]]) AS x FROM part),
    i AS (SELECT x, ln(1 + ((SELECT count(*) FROM part) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p WHERE x[2] IS NOT NULL GROUP BY x),
    t AS (SELECT * FROM p WHERE k % 20 = 0),
    s AS (SELECT t.k AS template, p.k AS record, sum(idf) AS score FROM t JOIN i USING (x) JOIN p USING (x) GROUP BY 1, 2)
    SELECT template, record, round(score, 6) AS score, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY template ORDER BY round(score, 9) DESC, record) AS rank FROM s) WHERE rank <= 20""")
def candidate_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set (every twentieth part) against all parts, 20 candidates each."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("record"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return matching.candidates(part.where("record % 20 = 0").withColumnRenamed("record", "template"), part, ["brand", "type", "size"], "template", "record")


_WIDE = {
    "shade": ("split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"), "kind": ("split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 2)"), "brand": ("p_brand", "p_brand"), "maker": ("left(p_brand, 7)", "left(p_brand, 7)"),
    "type": ("p_type", "p_type"), "letter": ("left(p_type, 1)", "left(p_type, 1)"), "size": ("p_size", "p_size"), "decade": ("p_size div 10", "p_size // 10"),
    "hundred": ("CAST(floor(p_retailprice / 100) AS INT)", "floor(p_retailprice / 100)::INT"), "thousand": ("CAST(floor(p_retailprice / 1000) AS INT)", "floor(p_retailprice / 1000)::INT"),
    "odd": ("IF(p_size % 2 = 1, 'odd', NULL)", "CASE WHEN p_size % 2 = 1 THEN 'odd' END"), "all": ("'part'", "'part'"),
}


@_query(f"""WITH p AS (SELECT p_partkey AS k, unnest([{", ".join(f"['{c}', lower(({sql})::VARCHAR)]" for c, (_, sql) in _WIDE.items())}]) AS x FROM part),
    i AS (SELECT x, ln(1 + ((SELECT count(*) FROM part) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p WHERE x[2] IS NOT NULL GROUP BY x),
    t AS (SELECT * FROM p WHERE k % 20 = 0),
    s AS (SELECT t.k AS template, p.k AS record, sum(idf) AS score FROM t JOIN i USING (x) JOIN p USING (x) GROUP BY 1, 2)
    SELECT template, record, round(score, 6) AS score, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY template ORDER BY round(score, 9) DESC, record) AS rank FROM s) WHERE rank <= 20""")
def wide_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates over twelve columns, some of them nested and one the same throughout, for the stated query set (every twentieth part)."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("record"), *[F.expr(e).alias(c) for c, (e, _) in _WIDE.items()])
    return matching.candidates(part.where("record % 20 = 0").withColumnRenamed("record", "template"), part, list(_WIDE), "template", "record")


_NATIONS = Model(Network("nations", ["nation", "name", "region"], [("nation", "name"), ("nation", "region")]), "nation")


@_query("""WITH w AS (SELECT n_nationkey AS nation, n_regionkey AS r, (count(s_suppkey) + 1)::DOUBLE AS w FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2),
    p AS (SELECT *, w / sum(w) OVER (PARTITION BY r) AS alone FROM w)
    SELECT c_custkey AS customer, c_nationkey AS matched, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END AS source, CASE WHEN c_custkey % 4 = 2 AND alone < 0.9 THEN 1 ELSE 0 END AS hint,
        CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS change, CASE c_custkey % 4 WHEN 1 THEN 'no region' WHEN 3 THEN 'spelling' ELSE '' END AS issues,
        CASE WHEN c_custkey % 4 = 2 AND alone >= 0.9 AND alone < 0.99 THEN 'single' ELSE 'immediate' END AS outcome, CASE WHEN c_custkey % 4 = 2 AND alone >= 0.9 THEN round(alone, 6) ELSE 1.0 END::DOUBLE AS probability
    FROM customer JOIN p ON c_nationkey = nation""")
def match_customers(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's nation, resolved stage by stage against the nations that suppliers weigh; what customers give is dealt out by key.

    Of four customers one gives name and region, one a wrong region (which a change removes), one its region alone with a hint of the
    name, and one a misspelt name alone (which a change of the template mends).
    """
    n, k = _t(spark, d, "nation"), F.col("c_custkey") % 4
    s = _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    records = n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    records = records.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"), (F.coalesce("n", F.lit(0)) + 1).cast("double").alias("weight"))
    c = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(k < 2, F.col("n_name")).when(k == 3, F.concat("n_name", F.lit("~")))
    region = F.when(k == 1, "nowhere").when(k != 3, F.col("n_regionkey").cast("string"))
    templates = c.select("c_custkey", name.alias("name"), region.alias("region"), F.when(k == 2, F.array("n_name")).alias("names"))
    mend = conditions.Change("spelling", (("name", F.rtrim(F.col("name"), F.lit("~"))),), F.endswith("name", F.lit("~")), (), ("spelling",))
    control = matcher.Control(_NATIONS, match_changes=((conditions.remove("region", ["region"], issue="no region"),),), hints={"name": "names"}, source_changes=((mend,),))
    out = matcher.match(control, resolver.build(_NATIONS, records), templates, "c_custkey")
    return out.select(F.col("c_custkey").alias("customer"), "matched", "stage.source", F.col("stage.hint").cast("int").alias("hint"), "stage.change", F.array_join("issues", ",").alias("issues"), "outcome", _r("posterior").alias("probability"))


@_query("""SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(p_name), '[[:punct:]]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part""")
def normalised_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), S.normalise(F.col("p_name"), remove_punctuation=True, lower=True).alias("name"))


@_query("""SELECT n_name AS name, list_aggregate(list_transform(list_filter([3, 4, 5, 6], lambda k: k < length(n_name)), lambda k: substr(n_name, 1, k)), 'string_agg', ',') AS prefixes FROM nation""")
def name_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.array_join(S.prefixes(F.col("n_name"), 2, 5), ",").alias("prefixes"))


@_query("""SELECT a.n_name AS a, b.n_name AS b,
    round(list_max(list_transform(range(0, least(length(a.n_name), length(b.n_name))::BIGINT + 1), lambda k: CASE WHEN lower(left(a.n_name, k::INT)) = lower(left(b.n_name, k::INT)) THEN k ELSE 0 END)) / greatest(length(a.n_name), length(b.n_name)), 6) AS fidelity
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def name_fidelity(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation")
    a = n.select(F.col("n_name").alias("a"), "n_regionkey", F.col("n_nationkey").alias("i"))
    b = n.select(F.col("n_name").alias("b"), "n_regionkey", F.col("n_nationkey").alias("j"))
    return a.join(b, "n_regionkey").where("i < j").select("a", "b", _r(S.prefix_fidelity(F.col("a"), F.col("b"))).alias("fidelity"))


@_query()
def name_phonetics(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select(F.col("n_name").alias("name"), S.phonetic(F.col("n_name")).alias("code"))


@_query("""SELECT o_orderkey AS id, (CASE WHEN o_orderstatus = 'F' THEN 'T' ELSE 'F' END) || (CASE WHEN o_totalprice > 100000 THEN 'T' ELSE 'F' END) AS signature FROM orders""")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    status, price = F.when(F.col("o_orderstatus") == "F", F.lit(1)), F.when(F.col("o_totalprice") > 100000, F.lit(1))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), matching.signature([[status], [price]]).alias("signature"))


@_query("""SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN NULL ELSE lower(p_brand) = lower('BRAND#' || (p_size % 5 + 1) || '3') END AS agrees FROM part""")
def three_valued_match(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    given = F.when(size > 25, None).otherwise(F.concat(F.lit("BRAND#"), (size % 5 + 1).cast("string"), F.lit("3")))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), matching.agrees(given, F.col("p_brand")).alias("agrees"))


@_query("""SELECT l_returnflag AS flag, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS spread, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1""")
def statistics(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), _r(F.sum(q), 2).alias("total"), _r(F.avg(q)).alias("mean"), _r(F.stddev_pop(q)).alias("spread"), F.min(q).alias("low"), F.max(q).alias("high"))


@_query("""SELECT o_orderpriority AS issue, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS weighted FROM orders GROUP BY 1""")
def issue_rates(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    total = o.agg(F.count("*").alias("all_n"), F.sum("o_totalprice").alias("all_w"))
    per = o.groupBy(F.col("o_orderpriority").alias("issue")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("w"))
    return per.crossJoin(F.broadcast(total)).select("issue", "n", _r(F.col("n") / F.col("all_n")).alias("share"), _r(F.col("w") / F.col("all_w")).alias("weighted"))


@_query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM supplier t WHERE t.s_suppkey = s.s_suppkey // 3) THEN s_suppkey // 3 ELSE s_suppkey END ELSE s_suppkey END AS accepted,
    s_suppkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_suppkey = s.s_suppkey // 3) AS missing FROM supplier s""")
def accepted_records(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms (every third supplier stands for another one) resolved to accepted records; missing ones are kept and flagged."""
    rows = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.expr("s_suppkey div 3")).alias("stands_for"))
    return hierarchy.resolve_accepted(rows, "id", "stands_for").select("id", "accepted", "missing")


@_query(f"""WITH {_PLACES}, n AS (SELECT * FROM places WHERE parent >= 1000)
    SELECT a.id AS a, b.id AS b, CASE WHEN a.parent = b.parent THEN a.parent ELSE 1 END AS common FROM n a JOIN n b ON b.id = a.id + 1""")
def least_upper_bound(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy.trails(_places(spark, d), "id", "parent").where("depth = 2").select("id", "trail")
    b = t.select(F.col("id").alias("b"), (F.col("id") - 1).alias("a"), F.col("trail").alias("other"))
    return t.withColumnRenamed("id", "a").join(b, "a").select("a", "b", F.element_at(hierarchy.common_trail(F.col("trail"), F.col("other")), -1).alias("common"))


@_query("""SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 2.5 WHEN c_nationkey = 7 THEN 1.5 ELSE 1.0 END::DOUBLE AS boost FROM customer""")
def area_boosts(spark: SparkSession, d: str) -> DataFrame:
    areas = spark.createDataFrame([(1, 3, 2.5), (2, 7, 1.5), (3, 3, 9.0)], "area_order int, area_location int, boost double")
    points = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return matching.first_boost(points, areas, "id", "c_nationkey").select("id", "boost")


@_query("""SELECT p_brand AS brand, p_size AS size, min(p_partkey) AS id FROM part GROUP BY 1, 2""")
def unique_records(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return archive.unique_keys(part, ["brand", "size"]).select("brand", "size", "id")


@_query("""SELECT n_name AS name, round(10 / (ln(greatest(4, length(n_name))) + 1) * CASE WHEN n_regionkey = 1 THEN 10 ELSE 1 END, 6) AS weight FROM nation""")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select(F.col("n_name").alias("name"), _r(matching.suggestion_weight(F.col("n_name"), F.col("n_regionkey") == 1)).alias("weight"))


@_query("""WITH g AS (SELECT n_regionkey AS r, unnest(list_distinct(list_transform(range(1, greatest(length(n_name) - 2, 1)::BIGINT + 1), lambda k: lower(substr(n_name, k::INT, 3))))) AS gram FROM nation)
    SELECT r AS region, gram, count(*)::BIGINT AS n FROM g GROUP BY 1, 2""")
def name_ngrams(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.explode(S.ngrams(F.col("n_name"), 3, 3)).alias("gram"))
    return n.groupBy("region", "gram").agg(F.count("*").alias("n"))


@_query("""WITH t AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer)
    SELECT id, 0 AS trial, '' AS changed, segment, nation FROM t UNION ALL SELECT id, 1, 'no_nation', segment, NULL FROM t
    UNION ALL SELECT id, 2, 'no_segment', NULL, nation FROM t UNION ALL SELECT id, 3, 'no_segment,no_nation', NULL, NULL FROM t""")
def modified_templates(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    changes = {"no_segment": {"segment": F.lit(None).cast("string")}, "no_nation": {"nation": F.lit(None).cast("int")}}
    out = matching.modified(t, changes, [["no_segment"], ["no_nation"]])
    return out.select("id", "trial", F.array_join("changed", ",").alias("changed"), "segment", "nation")


@_query("""SELECT l_orderkey AS id, round(1 - product(1 - l_discount), 9) AS boost FROM lineitem GROUP BY 1""")
def combined_boosts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(_r(1 - F.product(1 - F.col("l_discount")), 9).alias("boost"))


@_query("""WITH p AS (SELECT r.v AS rain, s.v AS sprinkler, w.v AS wet,
        (CASE WHEN r.v THEN 0.2 ELSE 0.8 END) * (CASE WHEN s.v THEN CASE WHEN r.v THEN 0.01 ELSE 0.4 END ELSE CASE WHEN r.v THEN 0.99 ELSE 0.6 END END)
        * (CASE WHEN w.v THEN x ELSE 1 - x END) AS p
        FROM (VALUES (true), (false)) r(v), (VALUES (true), (false)) s(v), (VALUES (true), (false)) w(v), LATERAL (SELECT CASE WHEN r.v AND s.v THEN 0.99 WHEN r.v THEN 0.8 WHEN s.v THEN 0.9 ELSE 0.01 END AS x)),
    e(seen_sprinkler, seen_wet) AS (VALUES (NULL, NULL), (false, NULL), (true, NULL), (NULL, false), (NULL, true), (false, true), (true, false), (true, true))
    SELECT seen_sprinkler, seen_wet, round(sum(p)::DOUBLE, 6) AS evidence, round(sum(CASE WHEN rain THEN p ELSE 0 END) / sum(p), 6) AS posterior
    FROM e JOIN p ON coalesce(sprinkler = seen_sprinkler, true) AND coalesce(wet = seen_wet, true) GROUP BY 1, 2""")
def network_posterior(spark: SparkSession, d: str) -> DataFrame:
    """Exact inference in a three-vertex network for every pattern of evidence."""
    net = Network.read('{"id": "garden", "vertices": ["rain", "sprinkler", "wet"], "edges": [{"source": "rain", "target": "sprinkler"}, {"source": "rain", "target": "wet"}, {"source": "sprinkler", "target": "wet"}]}')
    given = {"prior_rain": 0.2, "inf_sprinkler_t$t": 0.01, "inf_sprinkler_t$f": 0.4, "inf_wet_t$tt": 0.99, "inf_wet_t$tf": 0.8, "inf_wet_t$ft": 0.9, "inf_wet_t$ff": 0.01}
    seen = spark.createDataFrame([(None, None), (False, None), (True, None), (None, False), (None, True), (False, True), (True, False), (True, True)], "seen_sprinkler boolean, seen_wet boolean")
    found = net.posterior("rain", {"sprinkler": F.col("seen_sprinkler"), "wet": F.col("seen_wet")}, given)
    return seen.select("seen_sprinkler", "seen_wet", _r(found["evidence"]).alias("evidence"), _r(found["posterior"]).alias("posterior"))


@_query("""SELECT n_nationkey AS nation, (SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey) AS names FROM nation""")
def collected_names(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("names"))
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    return n.join(c, F.col("nation") == F.col("c_nationkey"), "left").select("nation", "names")


@_query("""SELECT doc_id, CASE WHEN lower(source) IN ('src0', 'src1') THEN NULL ELSE source END AS source FROM documents""")
def cleaned_values(spark: SparkSession, d: str) -> DataFrame:
    marked = F.when(F.col("source").isin("src0", "src1"), F.lit(" Not  Recorded ")).otherwise(F.col("source"))
    return _t(spark, d, "documents").select("doc_id", S.given(marked).alias("source"))


@_query("""SELECT o_custkey AS customer, o_orderkey AS id, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def result_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("id"), "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
