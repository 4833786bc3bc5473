"""Sources, ids and marks, derived values, sets of names: known values and edge cases."""

import zipfile

import pytest
from pyspark.sql import functions as F

from credal.functions import dates
from credal.operators import building
from credal.sources import archive

META = """<archive xmlns="http://rs.tdwg.org/dwc/text/"><core rowType="http://x/Taxon" fieldsTerminatedBy="," ignoreHeaderLines="1"><files><location>taxon.csv</location></files><id index="0"/>
<field index="1" term="http://x/name"/><field index="2" term="http://x/label"/></core><extension rowType="http://x/Common" fieldsTerminatedBy="," ignoreHeaderLines="1"><files><location>common.csv</location></files>
<coreid index="0"/><field index="1" term="http://x/label"/><field index="2" term="http://x/status"/></extension></archive>"""
FILES = {"meta.xml": META, "taxon.csv": "id,name,label\n1,Acacia,wattle\n2,Poa,\n", "common.csv": "id,label,status\n1,zebra,local\n1,acorn,deprecated\n1,mulga,standard\n9,lost,local\n"}


@pytest.fixture
def packed(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in FILES.items():
            z.writestr(name, text)
    return str(path)


def test_archives_packed_or_not(spark, tmp_path, packed):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    for place in (str(tmp_path), f"file://{packed}"):
        core, files = archive.source(spark, place)
        assert core == "Taxon" and sorted(r["label"] for r in files["Common"].collect()) == ["acorn", "lost", "mulga", "zebra"]
    (tmp_path / "t.csv").write_text("id,name\n1,x\n")
    kind, files = archive.source(spark, str(tmp_path / "t.csv"))
    assert kind == "record" and files[kind].collect() == [("1", "x")]
    with pytest.raises(ValueError):
        archive.source(spark, "table.xlsx")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError):
        archive.unpacked(spark, str(tmp_path / "bad.zip"))


def test_observables_of_archive_rows(spark, packed):
    core, files = archive.source(spark, packed)
    both = {"Taxon", "Common"}
    get = lambda kind, terms, **named: {(r["_id"], r["label"] if "label" in r.asDict() else None): r["v"] for r in archive.accessed(files, core, kind, "v", terms, **named).collect()}
    assert get("Taxon", ["label"]) == {("1", "wattle"): ["wattle"], ("2", None): []}
    assert get("Taxon", ["label"], classes=both)["1", "wattle"] == ["wattle", "acorn", "mulga", "zebra"]
    assert get("Taxon", ["label"], classes=both, how="first")["1", "wattle"] == ["wattle", "zebra"]
    assert get("Taxon", ["label"], classes=both, how="min", where=archive.FILTERS["current names"](), order=archive.ORDERS["common names"]())["1", "wattle"] == ["wattle", "mulga"]
    assert get("Common", ["name"]) == {("1", x): ["Acacia"] for x in ("zebra", "acorn", "mulga")}
    assert get("Common", ["label"], link=True)["1", "acorn"] == ["wattle"]
    assert get("Common", ["nothing"])["1", "acorn"] == []


def test_ids_marks_and_the_tree(spark):
    rows = [("a", None, None, 1), ("a", "a", None, 2), (None, "a", None, 3), ("s", "", "a", 4), ("o", "gone", None, 5), ("s2", None, "a", 6)]
    df = spark.createDataFrame(rows, "id string, parent string, accepted string, n int")
    got = {r.n: r for r in building.annotated(df, "id", F.col("n"), "parent", "accepted").collect()}
    assert {n: r.annotations for n, r in got.items()} == {1: ["isRoot"], 2: ["identifierCreated"], 3: ["identifierCreated"], 4: ["isSynonym"], 5: [], 6: ["isSynonym"]}
    assert got[1].id == "a" and len({r.id for r in got.values()}) == 6
    import uuid

    assert uuid.UUID(got[2].id).version == 8 and got[2].id == {r.n: r for r in building.annotated(df, "id", F.col("n")).collect()}[2].id
    tree = df.where("n in (1, 5, 6)")
    assert sorted(r.id for r in building.expanded(tree, "id", "parent", "accepted").collect()) == ["a", "s2"]
    assert [r.id for r in building.orphans(tree, "id", "parent", "accepted").collect()] == ["o"]
    assert building.expanded(df.limit(0), "id", "parent", "accepted").collect() == [] and building.annotated(df.limit(0), "id", F.col("n")).collect() == []


def test_values_that_are_derived_or_carried_over(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "own", None)], "id int, b string, a string")
    out = building.derived(df, {"c": (["b"], F.concat("b", F.lit("!"))), "b": (["a"], F.upper("a"))}).orderBy("id").collect()
    assert [(r.b, r.c) for r in out] == [("X", "X!"), ("own", "own!")]
    with pytest.raises(ValueError):
        building.derived(df, {"c": (["b"], F.col("b")), "b": (["c"], F.col("c"))})
    assert [tuple(r) for r in df.orderBy("id").select(building.filled(F.col("a"), F.col("b")), building.filled(F.col("a"), F.col("b"), True)).collect()] == [("x", "x"), ("own", "own")]
    one = spark.range(1).select(building.alternates(F.array(F.lit("a")), F.array(*map(F.lit, "abcb"))), building.identifiers(F.lit(None).cast("array<string>"), F.lit("z")), building.has_mark(F.lit(None).cast("array<string>"), "isRoot")).first()
    assert tuple(one) == (["b", "c"], ["z"], False)
    both = building.loaded([df, spark.createDataFrame([(1,)], "z int")]).collect()
    assert len(both) == 3 and both[-1].id is None


def test_lookups(spark):
    names = spark.createDataFrame([("t", "b", 1.0), ("t", "a", 2.0), ("t", "b", 3.0), ("t", None, 9.0), ("u", "c", 1.0)], "taxon string, name string, w double")
    assert {r.taxon: r.names for r in building.common_names(names, "taxon", "name", "w").collect()} == {"t": ["b", "a"], "u": ["c"]}
    index = spark.createDataFrame([("r1", None), ("r2", "r1")], "id string, accepted string")
    asked = spark.createDataFrame([("x", "r1"), ("x", "r2"), ("x", "r9")], "fragment string, record string")
    get = lambda **n: sorted((r.record, r.stands_for) for r in building.suggested_records(asked, "record", index, "id", "accepted", **n).collect())
    assert get() == [("r1", "r1"), ("r2", "r1")] and get(synonyms=False) == [("r1", "r1")]


def test_dates(spark):
    texts = ["2020-02-29", "Feb 3, 2021", "2/3/21", " ", None, "soon", "2021-13-01"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k").select(dates.date_text(dates.date_of(F.col("x"))).alias("d")).collect()
    assert [r.d for r in got] == ["2020-02-29", "2021-02-03", "2021-02-03", None, None, None, None]
    day = lambda x: F.lit(x).cast("date")
    assert tuple(spark.range(1).select(dates.date_likeness(day("2020-01-01"), day("2020-01-16")), dates.date_likeness(day("2020-01-01"), day(None)), dates.date_likeness(day(None), day("2020-01-01")), dates.date_likeness(day("2020-01-01"), day("2021-01-01"))).first()) == (0.5, 0.0, None, 0.0)
