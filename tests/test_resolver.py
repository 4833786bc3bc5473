"""The network's program against the full joint distribution, and records resolved from end to end."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from credal.operators import conditions as C
from credal.plans import matcher, resolver
from credal.plans.network import Network

NETS = {
    "triangle": (["a", "b", "c"], [("a", "b"), ("a", "c"), ("b", "c")]),
    "chain": (["a", "b", "c"], [("a", "b"), ("b", "c")]),
    "diamond": (["a", "b", "c", "d"], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]),
    "fork": (["a", "b", "c"], [("a", "b"), ("a", "c")]),
    "alone": (["a"], []),
}


@pytest.mark.parametrize("name", sorted(NETS))
def test_program_equals_the_joint_distribution(spark, name):
    vertices, edges = NETS[name]
    net, rng = Network(name, vertices, edges), random.Random(name)
    values = {p: F.lit(rng.uniform(0.05, 0.95)) for p in net.parameter_names()}
    seen = vertices[1:]
    cases = list(itertools.product((True, False, None), repeat=len(seen)))
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int" + "".join(f", {v} boolean" for v in seen))
    given = {v: F.col(v) for v in seen}
    want = net.posterior("a", given, values)
    out = net.program(df.withColumns({"want_e": want["evidence"], "want_p": want["posterior"]}), "a", given, values, values["prior_a"])
    for r in out.collect():
        assert math.isclose(r.evidence, r.want_e, abs_tol=1e-12) and math.isclose(r.posterior, r.want_p, abs_tol=1e-12), r


MODEL = resolver.Model(Network("n", ["id", "genus", "epithet", "family"], [("id", "epithet"), ("id", "genus"), ("id", "family"), ("genus", "family")]), "id", accepted="stands")


def _records(spark):
    rows = [("r1", "Osphranter", "rufus", "Macropodidae", 70.0, None), ("r2", "Acacia", "dealbata", "Fabaceae", 100.0, None), ("r3", "Acacia", "abbreviata", "Fabaceae", 20.0, None),
            ("r4", "Montitega", "dealbata", "Ericaceae", 30.0, None), ("r5", "Agathis", "atropurpurea", "Araucariaceae", 10.0, None), ("r6", "Agathis", None, "Braconidae", None, None), ("r7", "Racosperma", "dealbatum", "Fabaceae", 1.0, "r2")]
    return spark.createDataFrame(rows, "id string, genus string, epithet string, family string, weight double, stands string")


def test_records_resolve(spark):
    index = resolver.build(MODEL, _records(spark))
    assert {r.id: r.signature for r in index.collect()} == {f"r{k}": "TTT" if k != 6 else "TFT" for k in range(1, 8)}
    r2 = index.where("id = 'r2'").first()
    assert math.isclose(r2["genus|id|t"], 1 - 1e-9) and math.isclose(r2["genus|id|f"], 20 / 132) and math.isclose(r2["family|id+genus|ff"], 1 / 112)
    assert [r2[f"family|id+genus|{s}"] for s in ("tt", "tf", "ft")] == [1 - 1e-9, 1e-9, 1 - 1e-9]
    rows = [("t1", "acacia", "dealbata", "Fabaceae"), ("t2", None, "rufus", None), ("t3", "Agathis", None, "Braconidae"), ("t4", "Racosperma", "dealbatum", None), ("t5", "Nothing", "none", None), ("t6", None, None, None), ("t7", "Osphranter", "wrong", "Macropodidae")]
    t = spark.createDataFrame(rows, "tid string, genus string, epithet string, family string")
    got = {r.tid: r for r in resolver.resolve(MODEL, index, t, "tid", [[C.remove("epithet", ["epithet"], issue="removed epithet")]]).collect()}
    assert {k: (r.matched, r.accepted) for k, r in got.items()} == {"t1": ("r2", "r2"), "t2": ("r1", "r1"), "t3": ("r6", "r6"), "t4": ("r7", "r2"), "t7": ("r1", "r1")}
    assert got["t1"].issues == [] and got["t7"].issues == ["removed epithet"] and got["t7"].trial == 1 and got["t1"].posterior > 0.9
    ids = spark.createDataFrame([("q", "r7"), ("z", "none")], "q string, want string")
    assert [(r.q, r.accepted, r.posterior) for r in resolver.by_identifier(MODEL, index, ids, "want").collect()] == [("q", "r2", 1.0)]


def test_nothing_to_resolve(spark):
    empty = resolver.build(MODEL, _records(spark).limit(0))
    t = spark.createDataFrame([("t1", "Acacia", None, None)], "tid string, genus string, epithet string, family string")
    assert resolver.resolve(MODEL, empty, t, "tid").collect() == []
    assert resolver.resolve(MODEL, resolver.build(MODEL, _records(spark)), t.limit(0), "tid").collect() == []


def test_groups_of_vertices_share_a_place_in_the_signature(spark):
    vertices = ["id", "genus", "epithet", *[f"p{k}" for k in range(8)]]
    edges = [("id", "genus"), ("id", "epithet"), *[("genus", f"p{k}") for k in range(8)]]
    model = resolver.Model(Network("wide", vertices, edges, {"genus": "name", "epithet": "name"} | {f"p{k}": "place" for k in range(8)}), "id")
    assert list(model.groups()) == ["name", "place"] and model.sub("TF").vertices == ["id", "genus", "epithet"]
    rows = [(f"r{k}", f"g{k % 5}", f"e{k}", *[f"v{(k % 5) * 10 + j}" if k % 4 else None for j in range(8)]) for k in range(40)]
    records = spark.createDataFrame(rows, "id string, genus string, epithet string" + "".join(f", p{k} string" for k in range(8))).withColumn("weight", F.lit(1.0))
    index = resolver.build(model, records.withColumn("p7", F.when(F.col("id") == "r1", None).otherwise(F.col("p7"))))
    assert {r.id: r.signature for r in index.collect()} == {f"r{k}": "TT" if k % 4 else "TF" for k in range(40)}
    got = {r.t: r.matched for r in resolver.resolve(model, index, records.withColumnRenamed("id", "t"), "t").collect()}
    assert got == {f"r{k}": f"r{k}" for k in range(40)}


TAXA = resolver.Model(Network("taxa", ["id", "name", "family"], [("id", "name"), ("id", "family")]), "id", accepted="stands")


def _taxa(spark):
    rows = [
        ("r1", "Acacia dealbata", "Fabaceae", "accepted", "species", "ICBN", None, 10.0), ("r2", "Racosperma dealbatum", "Fabaceae", "homotypicSynonym", "species", "ICBN", "r1", 1.0),
        ("r3", "Agathis", "Araucariaceae", "accepted", "genus", "ICBN", None, 5.0), ("r4", "Agathis", "Braconidae", "accepted", "genus", "ICZN", None, 5.0),
        ("r5", "Poa annua", "Poaceae", "accepted", "species", "ICBN", None, 10.0), ("r6", "Poa annua", "Poaceae", "synonym", "species", "ICBN", "r1", 1.0), ("r7", "Acacia falsa", "Fabaceae", "misapplied", "species", "ICBN", "r1", 1.0),
    ]
    return spark.createDataFrame(rows, "id string, name string, family string, status string, rank string, code string, stands string, weight double")


def test_the_taxon_list_settles_staged_matches(spark):
    index = resolver.build(TAXA, _taxa(spark))
    fields = {x: x for x in ("name", "rank", "status", "code", "weight")}
    drop = C.remove("family", ["family"], issue="removed family")
    control = matcher.Control(TAXA, possible=matcher.possible_taxon(), match_changes=((drop,),), source_changes=((C.remove("name", ["name"], issue="removed name"),),), fields=fields, name="name")
    rows = [("t1", "acacia dealbata", None), ("t2", "Agathis", None), ("t3", "Agathis", "Braconidae"), ("t4", "Poa annua", None), ("t5", "Acacia falsa", None), ("t6", "Acacia dealbata", "Poaceae"), ("t7", "Nothing", None), ("t8", None, None), ("t9", "Racosperma dealbatum", "Fabaceae")]
    t = spark.createDataFrame(rows, "t string, name string, family string")
    got = {r.t: r for r in matcher.match(control, index, t, "t").collect()}
    assert {k: (r.matched, r.accepted, r.outcome, r.valid, r.issues) for k, r in got.items()} == {
        "t1": ("r1", "r1", "rule 2", True, []), "t2": ("r3", "r3", "rule 3", False, ["unresolved homonym"]), "t3": ("r4", "r4", "rule 2", True, []), "t4": ("r5", "r5", "rule 6", True, ["accepted and synonym"]),
        "t5": ("r7", "r1", "rule 2", True, ["misapplied"]), "t6": ("r1", "r1", "rule 2", True, ["removed family"]), "t9": ("r2", "r1", "rule 2", True, []),
    }
    assert got["t6"].stage == (0, 0, 1) and got["t1"].stage == (0, 0, 0) and math.isclose(got["t2"].posterior, 0.5, abs_tol=1e-6)
    assert matcher.match(control, index, t.limit(0), "t").collect() == []
    only = matcher.Control(TAXA, valid=C.presence_kept(F.col("signature"), 1, F.col("given_family"), F.lit(None).cast("string")), prepare=lambda df: df.withColumn("name", F.initcap("name")))
    assert [(r.t, r.matched, r.outcome, r.issues) for r in matcher.match(only, index, t.where("t = 't3'").withColumn("issues", F.array(F.lit("given"))), "t").collect()] == [("t3", "r4", "immediate", ["given"])]
