"""Queries of the taxonomic, hierarchical and decision operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credal.functions import names, taxonomy
from credal.operators import conditions as C
from credal.operators import decisions, hierarchy, matching, parameters, waves
from credal.plans import resolver
from credal.plans.base import PLACES, places, query, rounded, table
from credal.plans.network import Network


def _joined(c: Column) -> Column:
    return F.array_join(c, ",")


@query(f"""WITH {PLACES} SELECT p.id, CASE WHEN p.parent >= 1000 AND q.name LIKE 'A%' THEN q.name ELSE '' END AS names FROM places p LEFT JOIN places q ON q.id = p.parent""")
def broaden_up(spark: SparkSession, d: str) -> DataFrame:
    """Names of the ancestors while their name begins with A."""
    out = hierarchy.broaden(places(spark, d), "id", "parent", "name", F.col("name").like("A%"))
    return out.select("id", _joined(F.col("names")).alias("names"))


@query(f"""WITH {PLACES}, a AS (SELECT * FROM places WHERE name LIKE 'A%'),
    r AS (SELECT parent AS id, name FROM a WHERE parent IS NOT NULL UNION SELECT b.parent, a.name FROM a JOIN a b ON a.parent = b.id)
    SELECT p.id, coalesce(string_agg(DISTINCT r.name, ',' ORDER BY r.name), '') AS names FROM places p LEFT JOIN r ON r.id = p.id GROUP BY p.id""")
def broaden_down(spark: SparkSession, d: str) -> DataFrame:
    """Names of the descendants that are reached over names which begin with A."""
    out = hierarchy.broaden(places(spark, d), "id", "parent", "name", F.col("name").like("A%"), up=False)
    return out.select("id", _joined(F.col("names")).alias("names"))


@query(f"""WITH {PLACES} SELECT p.id, CASE WHEN p.id >= 1000 AND p.id < 10000 THEN p.name WHEN p.id >= 10000 THEN q.name END AS region FROM places p LEFT JOIN places q ON q.id = p.parent""")
def copied_from_above(spark: SparkSession, d: str) -> DataFrame:
    """Each place's region: its own name, or that of the nearest region above it."""
    return hierarchy.copy_from_above(places(spark, d), "id", "parent", F.col("id").between(1000, 9999), {"region": "name"})


_STANDS = "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 4 = 0 THEN p_partkey // 4 END AS stands_for, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS kind FROM part"


def _stands(spark: SparkSession, d: str) -> DataFrame:
    """Parts of which every fourth stands for another one and has no type of its own."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(k % 4 == 0, F.expr("p_partkey div 4")).alias("stands_for"), F.when(k % 4 != 0, F.col("p_type")).alias("kind"))


@query(f"WITH p AS ({_STANDS}) SELECT a.id, coalesce(string_agg(DISTINCT s.name, ',' ORDER BY s.name), '') AS names FROM p a LEFT JOIN p s ON s.stands_for = a.id AND s.brand <> a.brand GROUP BY a.id")
def synonym_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the parts that stand for each part, of another brand."""
    out = hierarchy.synonym_names(_stands(spark, d), "id", "stands_for", "name", F.col("s_brand") != F.col("a_brand"))
    return out.select("id", _joined(F.col("names")).alias("names"))


@query(f"WITH p AS ({_STANDS}) SELECT s.id, coalesce(s.kind, a.kind) AS kind FROM p s LEFT JOIN p a ON s.stands_for = a.id")
def synonym_copies(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.copy_from_accepted(_stands(spark, d), "id", "stands_for", ["kind"]).select("id", "kind")


def _sum(where: str) -> str:
    return f"(SELECT coalesce(sum(p_retailprice), 0) FROM part p WHERE {where})"


_N, _S = "coalesce(split_part(p.p_type, ' ', 1) = t.m, false)", "coalesce(p.p_size = t.s, false)"
_PATTERNS = {"tt": f"{_N} AND {_S}", "tf": f"{_N} AND NOT {_S}", "ft": f"NOT {_N} AND {_S}", "ff": f"NOT {_N} AND NOT {_S}"}
_SIGNED = ", ".join(
    f"round(CASE WHEN {_sum(w)} < 1e-9 THEN 1e-9 ELSE greatest(1e-9, least(1 - 1e-9, {_sum(w + ' AND p.p_brand = t.b')} / {_sum(w)})) END, 6) AS p_{k}" for k, w in _PATTERNS.items()
)


@query(f"WITH t AS (SELECT DISTINCT p_brand AS b, split_part(p_type, ' ', 1) AS m, p_size AS s FROM part) SELECT b AS brand, m AS kind, s AS size, {_SIGNED} FROM t")
def signed_conditionals(spark: SparkSession, d: str) -> DataFrame:
    """The brand's probability by weight for every sign pattern of kind and size; the SQL is the direct definition."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("w"))
    out = parameters.signed_conditionals(part, "brand", ["kind", "size"], "w")
    return out.select("brand", "kind", "size", *[rounded(f"p_{s}").alias(f"p_{s}") for s in _PATTERNS])


_DIRTY = ["'Acacia ' || w", "'\"Acacia ' || w || '\"'", "'Acacia ' || w || ' subsp. ' || w", "'Acacia aff ' || w", "'Acacia ? ' || w", "'Acacia sp.'", "'Acacia (genus) ' || w"]
_CLEAN = ["'Acacia ' || w", "'Acacia ' || w", "'Acacia ' || w || ' ' || w", "'Acacia aff. ' || w", "'Acacia ' || w", "'Acacia'", "'Acacia ' || w"]
_FOUND = ["", "", "rank marker", "affinity", "indeterminate", "rank ending", "comment"]
_BY = lambda xs: "CASE " + " ".join(f"WHEN k % 7 = {i} THEN {x}" for i, x in enumerate(xs)) + " END"


@query(f"""SELECT k AS id, {_BY(_CLEAN)} AS name, {_BY([f"'{x}'" for x in _FOUND])} AS issues, {_BY(["NULL", "NULL", "'subspecies'", "NULL", "NULL", "'unranked'", "NULL"])} AS rank
    FROM (SELECT p_partkey AS k, lower(split_part(p_type, ' ', 1)) AS w FROM part)""")
def analysed_names(spark: SparkSession, d: str) -> DataFrame:
    """Names built with known flaws from every part; the SQL states what each flaw must become."""
    rows = table(spark, d, "part").selectExpr("p_partkey AS k", "lower(split_part(p_type, ' ', 1)) AS w").selectExpr("k AS id", f"{_BY(_DIRTY)} AS given")
    return names.analyse(rows, "given").select("id", "name", _joined(F.col("issues")).alias("issues"), "rank")


def _sound_sql(word: str) -> str:
    lead = "CASE " + " ".join(f"WHEN starts_with({word}, '{a}') THEN '{b}' || substr({word}, {len(a) + 1})" for a, b in taxonomy.LEADING.items()) + f" ELSE {word} END"
    rest = "substr(x, 2)"
    for a, b in taxonomy.INNER:
        rest = f"replace({rest}, '{a}', '{b}')"
    out = f"left(x, 1) || {rest}"
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out = f"regexp_replace({out}, '{letter}{letter}+', '{letter}', 'g')"
    return f"list_transform([{lead}], lambda x: {out})[1]"


@query(f"""WITH w AS (SELECT p_partkey AS id, unnest(list_filter(string_split(upper(p_type), ' '), lambda w: w <> '')) AS w, unnest(range(1, 1 + len(list_filter(string_split(upper(p_type), ' '), lambda w: w <> '')))) AS k FROM part)
    SELECT id, string_agg(CASE WHEN k > 1 THEN regexp_replace(s, '(IS|IM|AS)$', 'A') ELSE s END, ' ' ORDER BY k) AS sound FROM (SELECT id, k, {_sound_sql("w")} AS s FROM w) GROUP BY id""")
def taxon_phonetics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), taxonomy.taxon_phonetic(F.col("p_type")).alias("sound"))


_RANK_VALUES = ", ".join(f"({i}, {a}, {b})" for _, i, a, b, _ in (line.split() for line in taxonomy.RANKS.splitlines()) if int(i) > 0)


@query(f"""WITH r(id, low, high) AS (VALUES {_RANK_VALUES}), v AS (SELECT p_partkey AS id, p_size * 175 AS value FROM part)
    SELECT v.id, value, coalesce((SELECT low FROM r WHERE r.id <= value ORDER BY r.id DESC LIMIT 1), -10000)::INTEGER AS low, coalesce((SELECT high FROM r WHERE r.id <= value ORDER BY r.id DESC LIMIT 1), 10000)::INTEGER AS high FROM v""")
def rank_ranges(spark: SparkSession, d: str) -> DataFrame:
    low, high = taxonomy.rank_range(F.col("value"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 175).alias("value")).select("id", "value", low.alias("low"), high.alias("high"))


@query("""SELECT p_partkey AS id, round(greatest(1, (ln(greatest(p_retailprice, 1)) + 1) * CASE p_size % 3 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 5 END * CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 1.5 END
    * CASE WHEN p_partkey % 5 = 0 THEN 0.1 ELSE 1 END), 4) AS weight, round(greatest(1, ln(p_size * 1000 / 1000) + 1) * CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END, 6) AS area_weight,
    greatest(1, CASE p_size % 3 WHEN 0 THEN 100 WHEN 1 THEN 20 ELSE 0.1 END * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0.1 END)::DOUBLE AS name_weight FROM part""")
def weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of taxa, places and common names, whose ranks and statuses are dealt out by key and size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rank = F.when(size % 3 == 0, "species").when(size % 3 == 1, "genus").otherwise("family")
    status, flag = F.when(k % 2 == 0, "accepted").otherwise("homotypicSynonym"), F.when(k % 5 == 0, F.array(F.lit("NUDUM"), F.lit("LEGITIMATE"))).otherwise(F.array(F.lit("LEGITIMATE")))
    name = taxonomy.common_name_weight(F.when(size % 3 == 2, "deprecated").otherwise("common"), rank, k % 2 == 0)
    return table(spark, d, "part").select(
        k.alias("id"), rounded(taxonomy.taxon_weight(F.col("p_retailprice"), rank, status, flag), 4).alias("weight"),
        rounded(taxonomy.location_weight((size * 1000).cast("double"), F.lit("other"), F.when(k % 5 == 0, 2.0))).alias("area_weight"), rounded(name, 4).alias("name_weight"),
    )


@query("""SELECT p_type AS name, count(DISTINCT p_brand) > 1 AS homonym FROM part GROUP BY 1""")
def homonyms(spark: SparkSession, d: str) -> DataFrame:
    """Whether parts of one type are of more than one brand; brands are gathered as a set, which is bounded by their number."""
    per = table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.collect_set("p_brand").alias("codes"))
    result = F.transform("codes", lambda c: F.struct(F.lit("accepted").alias("status"), F.col("name").alias("name"), c.alias("code")))
    return per.select("name", decisions.homonym(result, F.col("name")).alias("homonym"))


@query("""SELECT o_custkey AS query, o_orderpriority AS accepted, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS id FROM orders GROUP BY 1, 2""")
def first_per_accepted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("accepted"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return matching.first_per(rows, "query", "accepted", "score", "id").select("query", "accepted", "id")


@query("""SELECT p_partkey AS id, round(CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 0 WHEN p_size % 3 = 0 THEN 0.5 WHEN p_partkey % 2 = 0 THEN p_size / 50.0 ELSE (p_size / 50.0 + 0.5) / 2 END, 6) AS fidelity FROM part""")
def composite_fidelity(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    parts = [F.when(size % 3 != 0, size / 50.0), F.when(k % 2 != 0, F.lit(0.5))]
    return table(spark, d, "part").select(k.alias("id"), rounded(matching.mean_likeness(parts)).alias("fidelity"))


@query("""SELECT c_custkey AS id, CASE WHEN n = 0 THEN 'x' ELSE n::VARCHAR END AS country, CASE WHEN n = 0 THEN c_mktsegment || ' Island' ELSE c_mktsegment END AS place,
    CASE WHEN n = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN n = 0 THEN 'removed,suffixed' ELSE '' END AS issues FROM (SELECT *, c_nationkey % 5 AS n FROM customer)""")
def composite_changes(spark: SparkSession, d: str) -> DataFrame:
    """A guarded composite of a constant, an ending and a removal on the customers of every fifth nation."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).cast("string").alias("country"), F.col("c_mktsegment").alias("place"), F.col("c_acctbal").alias("balance"), F.array().cast("array<string>").alias("issues"))
    change = C.composite("all", [C.remove("balance", ["balance"], issue="removed"), C.suffix("place", "place", " Island", issue="suffixed"), C.assign("country", "country", "x", where=F.col("country") == "0")])
    return change.apply(rows).select("id", "country", "place", "balance", _joined(F.col("issues")).alias("issues"))


@query("""WITH k AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer), t AS (SELECT s_suppkey AS id, s_nationkey AS n, CASE s_suppkey % 3 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'ABSENT' END AS s FROM supplier)
    SELECT id, CASE WHEN s IS NULL OR (n, s) IN (SELECT (n, s) FROM k) THEN 0 WHEN s = 'FURNITURE' OR s = 'ABSENT' THEN 1 END AS trial FROM t
    WHERE n IN (SELECT n FROM k)""")
def match_waves(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers matched to a nation and segment that customers have; what finds nothing is tried again without the segment."""
    known = table(spark, d, "customer").select(F.col("c_nationkey").alias("kn"), F.col("c_mktsegment").alias("ks")).distinct()
    k = F.col("s_suppkey") % 3
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"), F.when(k == 0, "FURNITURE").when(k == 1, "ABSENT").alias("s"), F.array().cast("array<string>").alias("issues"))

    def match(t: DataFrame) -> DataFrame:
        given = t.where("s IS NOT NULL").join(known, (F.col("n") == F.col("kn")) & (F.col("s") == F.col("ks")), "left_semi").select("id")
        return given.unionByName(t.where("s IS NULL").join(known, F.col("n") == F.col("kn"), "left_semi").select("id"))

    return waves.in_waves(rows, "id", match, [[C.remove("segment", ["s"], issue="removed segment")]]).select("id", "trial")


_CASES = """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 5 END AS n, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 7 END AS o, o_custkey % 2 = 0 AS syn, o_orderkey % 5 AS z, o_totalprice AS w FROM orders)"""


@query(_CASES + """, k AS (SELECT *, CASE WHEN n IS NOT DISTINCT FROM o THEN 'same' WHEN o IS NULL THEN 'found' WHEN n IS NULL THEN CASE WHEN z = 0 THEN 'location' ELSE 'notFound' END
    WHEN z = 1 THEN 'lowerRank' WHEN z = 2 AND NOT syn THEN 'foundSynonym' WHEN syn AND z = 3 THEN 'parentChild' WHEN z = 0 AND o = 0 THEN 'location' WHEN z = 4 THEN 'higherRank' WHEN n % 2 <> o % 2 THEN 'kingdom'
    WHEN n = o - 2 THEN 'sameName' ELSE 'other' END AS class FROM c) SELECT class, count(*)::BIGINT AS n, round(sum(w), 2) AS weight, round(count(*) / (SELECT count(*) FROM k), 6) AS share FROM k GROUP BY 1""")
def comparison_classes(spark: SparkSession, d: str) -> DataFrame:
    """Old and new results, dealt out by key, compared and counted plainly and by weight."""
    sql = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 5 END AS n", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 7 END AS o", "o_custkey % 2 = 0 AS syn", "o_orderkey % 5 AS z", "o_totalprice AS w"
    n, o, z = F.col("n"), F.col("o"), F.col("z")
    new = {"id": n, "trail": F.when(z == 1, F.array(o)), "kingdom": n % 2, "name": n + 2, "accepted_by": F.when(z == 2, n), "issues": F.array().cast("array<string>"), "alone": F.when(z == 0, F.lit(0))}
    old = {"id": o, "trail": F.when(z == 4, F.array(n)), "kingdom": o % 2, "name": o, "synonym": F.col("syn"), "parent": F.when(z == 3, n)}
    rows = table(spark, d, "orders").selectExpr(*sql).withColumn("class", decisions.compared(new, old))
    total = rows.agg(F.count("*").alias("all_n"))
    per = rows.groupBy("class").agg(F.count("*").alias("n"), rounded(F.sum("w"), 2).alias("weight"))
    return per.crossJoin(F.broadcast(total)).select("class", "n", "weight", rounded(F.col("n") / F.col("all_n")).alias("share"))


@query("""SELECT id, CASE WHEN x >= 0 AND x < 4 AND y >= 0 AND y < 3000 AND NOT (x >= 1 AND x < 2 AND y >= 500 AND y < 1500) THEN 2.5 WHEN id % 7 = 3 THEN 1.5 ELSE 1.0 END::DOUBLE AS boost
    FROM (SELECT c_custkey AS id, c_nationkey AS x, c_acctbal AS y FROM customer)""")
def polygon_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Customers at (nation, balance) in a polygon with a hole, or at a named place."""
    wkt = "POLYGON ((0 0, 4 0, 4 3000, 0 3000, 0 0), (1 500, 2 500, 2 1500, 1 1500, 1 500))"
    areas = spark.createDataFrame([(1, None, wkt, 2.5), (2, "p3", None, 1.5)], "area_order int, area_location string, wkt string, boost double")
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("x"), F.col("c_acctbal").cast("double").alias("y"), F.array(F.concat(F.lit("p"), F.col("c_custkey") % 7)).alias("at"))
    return matching.first_area(points, areas, "id", "x", "y", "at", cell=1000.0).select("id", "boost")


@query("""SELECT p_partkey AS id, NOT (p_brand IS NOT NULL AND p_partkey % 2 = 0) OR p_size > 10 AS kept, (CASE WHEN p_size BETWEEN 5 AND 20 THEN 1 ELSE 0 END + CASE WHEN lower(p_type) LIKE '%y' THEN 2 ELSE 0 END)::DOUBLE AS score
    FROM part WHERE lower(p_brand) <> 'brand#11'""")
def observed_records(spark: SparkSession, d: str) -> DataFrame:
    """Required, optional, negative, range and wildcard observations, and the candidate filter by signature."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size").withColumn("signature", matching.signature([[F.when(F.col("p_size") > 10, F.lit(1))]]))
    found = C.searched(part, [C.observed("p_brand", "BRAND#11", sign=False)], [(C.observed("p_size", (5, 20), style="range"), 1.0), (C.observed("p_type", "*y", style="wildcard"), 2.0)])
    given = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))
    return found.select(F.col("p_partkey").alias("id"), C.presence_kept(F.col("signature"), 0, given, F.lit(None).cast("string")).alias("kept"), "score")


@query("""SELECT s_suppkey AS id, f.field, f.value FROM supplier, LATERAL (VALUES ('s_name', s_name), ('s_nationkey', s_nationkey::VARCHAR)) f(field, value) WHERE f.value IS NOT NULL""")
def template_observations(spark: SparkSession, d: str) -> DataFrame:
    return C.observations(table(spark, d, "supplier"), "s_suppkey", ["s_name", "s_nationkey"])


@query()
def suggested_names(spark: SparkSession, d: str) -> DataFrame:
    """Part types for fragments of every brand's usual types: the first six letters of each word of each type."""
    known = table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").cast("double").alias("weight"))
    asked = known.select(F.explode(F.split("name", " ")).alias("w")).select(F.left("w", F.lit(6)).alias("fragment")).distinct()
    return matching.suggest(known, asked).withColumn("score", rounded("score"))


def _likely(column: str) -> str:
    """The probability of agreeing or not on a column, with the record (1 less the least) and without it."""
    other = f"least(1 - 1e-9, greatest(1e-9, (w_{column} - w) / (total - w)))"
    return f"CASE WHEN t_{column} IS NULL OR {column} IS NULL THEN 1 WHEN t_{column} = {column} THEN {{}} ELSE 1 - {{}} END".format("1 - 1e-9", "(1 - 1e-9)"), f"CASE WHEN t_{column} IS NULL OR {column} IS NULL THEN 1 WHEN t_{column} = {column} THEN {other} ELSE 1 - {other} END"


_LIKELY = [_likely(c) for c in ("brand", "kind", "size")]


@query(f"""WITH r AS (SELECT p_partkey AS id, lower(p_brand) AS brand, lower(p_type) AS kind, p_size AS size, p_retailprice::DOUBLE AS w FROM part),
    a AS (SELECT *, sum(w) OVER (PARTITION BY brand) AS w_brand, sum(w) OVER (PARTITION BY kind) AS w_kind, sum(w) OVER (PARTITION BY size) AS w_size, sum(w) OVER () AS total FROM r),
    t AS (SELECT id AS template, brand AS t_brand, kind AS t_kind, CASE WHEN id % 40 = 0 THEN size END AS t_size FROM r WHERE id % 20 = 0),
    i AS (SELECT x, ln(1 + ((SELECT count(*) FROM r) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM (SELECT unnest([['b', brand], ['k', kind], ['s', size::VARCHAR]]) AS x FROM r) GROUP BY x),
    p AS (SELECT *, CASE WHEN t_brand = brand THEN (SELECT idf FROM i WHERE x = ['b', brand]) ELSE 0 END + CASE WHEN t_kind = kind THEN (SELECT idf FROM i WHERE x = ['k', kind]) ELSE 0 END
        + CASE WHEN t_size = size THEN (SELECT idf FROM i WHERE x = ['s', size::VARCHAR]) ELSE 0 END AS score FROM t, a WHERE t_brand = brand OR t_kind = kind OR t_size = size),
    k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY template ORDER BY round(score, 9) DESC, id) <= 20),
    e AS (SELECT template, id, w / total AS prior, {' * '.join(x for x, _ in _LIKELY)} AS yes, {' * '.join(x for _, x in _LIKELY)} AS no FROM k)
    SELECT template, id, round(prior * yes / (prior * yes + (1 - prior) * no), 6) AS posterior, round(prior * yes + (1 - prior) * no, 6) AS evidence FROM e""")
def resolved_parts(spark: SparkSession, d: str) -> DataFrame:
    """An index over all parts, weighted by price, and the candidates' posteriors for the stated query set (every twentieth part, half without size)."""
    k = F.col("p_partkey")
    part = table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("weight"))
    model = resolver.Model(Network("parts", ["id", "brand", "kind", "size"], [("id", "brand"), ("id", "kind"), ("id", "size")]), "id")
    asked = part.where("id % 20 = 0").select(F.col("id").alias("template"), "brand", "kind", F.when(F.col("id") % 40 == 0, F.col("size")).alias("size"))
    out = resolver.score(model, resolver.build(model, part), asked, "template")
    return out.select("template", "id", rounded("posterior").alias("posterior"), rounded("evidence").alias("evidence"))
