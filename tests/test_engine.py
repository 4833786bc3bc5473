"""The record-resolution engine: registered queries against their SQL, and the operators' edge cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from credal.functions import strings as S
from credal.operators import hierarchy, matching, parameters
from credal.plans import registry
from credal.plans.network import Network
from credal.sources import archive

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def _plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    rel = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([_plain(r[names.index(c)]) for c in sorted(names)]) for r in rel.fetchall())
    assert sorted(repr([_plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want


def test_known_posteriors(spark):
    got = {(r.seen_sprinkler, r.seen_wet): (r.posterior, r.evidence) for r in registry.queries()["network_posterior"](spark, SF).collect()}
    for seen, p in {(None, None): 0.2, (False, None): 0.2920, (True, None): 0.0062, (None, False): 0.0724, (None, True): 0.3539, (False, True): 0.9706, (True, False): 0.0006, (True, True): 0.0068}.items():
        assert math.isclose(got[seen][0], p, abs_tol=1e-4)
    assert math.isclose(got[False, True][1], 0.1632, abs_tol=1e-4)


def test_network_shape():
    net = Network("n", ["a", "b", "c"], [("a", "b"), ("b", "c")], {"b": "g"})
    assert net.ordered() == ["a", "b", "c"] and net.inputs() == ["a"] and net.outputs() == ["c"]
    assert net.signatures() == ["T", "F"] and net.erase({"g"}).edges == [("a", "c")]
    assert net.parameter_names() == ["prior_a", "inf_b_t$t", "inf_b_t$f", "inf_c_t$t", "inf_c_t$f"]
    with pytest.raises(ValueError):
        Network("n", ["a", "b"], [("a", "b"), ("b", "a")]).ordered()


def test_trial_order():
    assert matching.trials([["a"], ["b"]]) == [[], ["b"], ["a"], ["a", "b"]]


def test_tree_drops_orphans_and_numbers_subtrees(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (9, 8)], "id long, parent long")
    got = {r.id: (r.left, r.right) for r in hierarchy.numbering(hierarchy.trails(nodes, "id", "parent")).collect()}
    assert got == {4: (1, 1), 2: (1, 2), 3: (3, 3), 1: (1, 4)}


def test_priors_of_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], "v string, w double")
    assert parameters.priors(empty, "v", "w").collect() == []
    rows = spark.createDataFrame([("a", None), ("b", 3.0)], "v string, w double")
    assert {r.v: r.prior for r in parameters.priors(rows, "v", "w").collect()} == {"a": 0.25, "b": 0.75}


def test_strings(spark):
    df = spark.createDataFrame([("Café  Müller",), ("n/a",), (None,), ("",)], "x string")
    rows = df.select(S.normalise(F.col("x"), lower=True, accents=True).alias("n"), S.given(F.col("x")).alias("g"), S.phonetic(F.col("x")).alias("p")).collect()
    assert [r.n for r in rows] == ["cafe muller", "n/a", None, None] and [r.g for r in rows] == ["Café Müller", None, None, None]
    assert rows[0].p == "C100M460"
    one = spark.range(1).select(S.prefix_fidelity(F.lit("abcx"), F.lit("ABcyz")).alias("f"), S.ngrams(F.lit("abcd"), 3, 4).alias("g"), S.phrase(F.lit("sp. Bar-8 s.n.")).alias("p"), S.prefix_equal(F.lit("Acac"), F.lit("acacia")).alias("e")).first()
    assert (one.f, one.g, one.p, one.e) == (0.6, ["abc", "bcd", "abcd"], "SPBAR8", True)


def test_archive(spark, tmp_path):
    (tmp_path / "core.csv").write_text("id,name\n1,A\n2,B\n")
    (tmp_path / "ext.txt").write_text("coreid\tlabel\n1\tx\n1\ty\n7\tz\n")
    xml = """<archive xmlns="http://rs.tdwg.org/dwc/text/"><core fieldsTerminatedBy="," ignoreHeaderLines="1" rowType="http://e/Core"><files><location>core.csv</location></files><id index="0"/><field index="1" term="http://e/name"/></core>
    <extension fieldsTerminatedBy="\\t" ignoreHeaderLines="1" rowType="http://e/Ext"><files><location>ext.txt</location></files><coreid index="0"/><field index="1" term="http://e/label"/></extension></archive>"""
    core, (ext,) = archive.descriptor(xml, str(tmp_path))
    got = {r["_id"]: r["ext_label"] for r in archive.star(archive.read_file(spark, core), archive.read_file(spark, ext), ["label"]).collect()}
    assert got == {"1": ["x", "y"], "2": None}
    path = str(tmp_path / "index")
    archive.write_index(spark.range(2).toDF("id"), path)
    archive.write_index(spark.range(3).toDF("id"), path)
    assert spark.read.parquet(path).count() == 3 and len(list(tmp_path.glob("index-*"))) == 1
