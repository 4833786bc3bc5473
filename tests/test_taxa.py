"""Names, vocabularies, decisions, changes, waves, polygons, streams and documents: known values, brute force and edge cases."""

import functools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credal.functions import geometry as G
from credal.functions import names as N
from credal.functions import taxonomy as T
from credal.operators import conditions as C
from credal.operators import decisions as D
from credal.operators import hierarchy, matching, parameters, waves
from credal.plans import registry
from credal.plans.network import Network
from credal.sources import documents
from credal.streaming.templates import match_stream

# Names, rank, whether scientific, whether an epithet, phonetic form.
SOUNDS = """Acacia dealbata|species|1|0|ACACA DIALBATA
Acacia sp nov. dealbata|species|1|0|ACACA SP NAV DIALBATA
Muehlenbeckia sp. nov. 'costata'|species|1|0|MILINBICA CASTATA
Oligochaetochilus 'Belvidere' (D E Murfet 3603)|species|0|0|OLIGACITACILIS BILVIDIRI D E MIRFIT 3603
Oenochrominae s. str.|species|1|0|ENACRAMINI
Acacia aff. bivenosa (A.R.Chapman 601)|species|0|0|ACACA AF BIVINASA A.R.CAPMAN 601
Nitzschia cfr. bicapitata|species|1|0|NITCSA CF BICAPITATA
Canarium acutifolium var. acutifolium|species|1|0|CANARIM ACITIFALA ACITIFALA
Ficus subsect. Sycidium|species|1|0|FICIS SICIDA
Asplenium bulbiferum ssp. gracillimum|species|1|0|ASPLINIM BILBIFIRA GRACILIMA
Eubacteria|kingdom|1|0|UBACTIRA
Protozoa|kingdom|1|0|PRATACA
Acacia sp. H|species|0|0|ACACA SP. H
Billardiera coeruleo-punctata|species|1|0|BILARDIRA CIRILIAPINCTATA
acutifolium|species|1|0|ACITIFALIM
acutifolium|species|1|1|ACITIFALA"""

# Authorships and their one form.
AUTHORS = {
    "Latreille, 1831": "Latreille 1831", "Whittaker & Margulis": "Whittaker Margulis", "Woese et al.": "Woese +", "(ex Stanier 1974) Cavalier-Smith": "CavalierSmith",
    "Rothm. ex Stotler & Crand.-Stotl.": "Stotler CrandallStotler", "M.D.M. Jones & T.A. Richards": "Jones Richards", "Page & Blanton, 1985": "Page Blanton 1985",
    "R. Bauer, Garnica, Oberwinkler, Riess, Weiß & Begerow": "Bauer Garnica +", "(C. Walker & A. Schüßler)": "Walker Schussler", "Cronquist, Takht. & W.Zimm.": "Cronquist Takhtajan +",
    "L.": "Linnaeus", "Smirnov et al., 2005": "Smirnov + 2005", "(ex Aikimbaev, 1966) Olsufjev and Meshcheryakova, 1983": "Olsufjev Meshcheryakova 1983", "(Carini, 1939) ?": "Carini 1939", "-": None,
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_phonetic_forms(spark):
    cases = [line.split("|") for line in SOUNDS.splitlines()]
    got = one(spark, *[T.taxon_phonetic(F.lit(n), F.lit(r), sc == "1", ep == "1").alias(f"c{k}") for k, (n, r, sc, ep, _) in enumerate(cases)])
    assert list(got) == [c[-1] for c in cases]
    assert one(spark, T.taxon_phonetic(F.lit(" ")).alias("x"), T.taxon_phonetic(F.lit(None).cast("string")).alias("y")) == (None, None)


def test_author_forms(spark):
    known = {"L.": "Linnaeus", "Crand.-Stotl.": "CrandallStotler", "Takht.": "Takhtajan"}
    df = spark.createDataFrame([(a,) for a in [*AUTHORS, None, ""]], "a string")
    assert [r.x for r in df.select(N.authorship(F.col("a"), known).alias("x")).collect()] == [*AUTHORS.values(), None, None]


def test_name_analysis(spark):
    want = {
        '"Acacia dealbata"': ("Acacia dealbata", None, "scientific", []), "Acacia sp.": ("Acacia", "unranked", "informal", ["rank ending"]),
        "Acacia dealbata subsp. dealbata": ("Acacia dealbata dealbata", "subspecies", "scientific", ["rank marker"]), "Acacia cfr. dealbata": ("Acacia cf. dealbata", None, "informal", ["confer"]),
        "Acacia sp. nov. costata": ("Acacia sp. nov. costata", "species", "scientific", ["new species"]), "Acacia sp. Bondi (J. Smith 12)": ("Acacia sp. Bondi (J. Smith 12)", "species", "phrase", ["phrase name"]),
        "Acacia sp. 3": ("Acacia sp. 3", "species", "placeholder", ["code placeholder"]), "Incertae Sedis": ("Incertae Sedis", None, "invalid", ["invalid"]), None: (None, None, "scientific", []), "": (None, None, "scientific", []),
    }
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: (r["name"], r["rank"], r.kind, r.issues) for r in N.analyse(df, "n").collect()} == want
    kept = N.analyse(df, "n", canonical=False).where("n = 'Acacia sp.'").first()
    assert kept["name"] == "Acacia sp." and kept.issues == ["rank ending"]
    got = one(spark, N.alternating(F.lit("genus Acacia species dealbata")).alias("a"), N.alternating(F.lit("Acacia dealbata")).alias("b"), N.parts(F.lit("Acacia (Juli) dealbata subsp. subalpina (Link) Tindale")).alias("p"))
    assert got.a == {"genus": "Acacia", "species": "dealbata"} and got.b is None
    assert tuple(got.p) == ("Acacia", "Juli", "dealbata", "subalpina", None, "(Link) Tindale")


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    n = max(len(a), len(b))
    return 1 - (len(a) + len(b) - 2 * t[-1][-1]) / n if n else 1.0


def test_common_subsequence_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [("preiss", "Malva preissiana"), ("", ""), ("", "a"), ("b", "")] + [("".join(rng.choices("abc", k=rng.randint(0, 9))), "".join(rng.choices("abcd", k=rng.randint(0, 9)))) for _ in range(40)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", N.lcs_likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(math.isclose(r.x, _lcs(r.a, r.b), abs_tol=1e-12) for r in rows) and rows[0].x == 0.375


def test_vocabularies(spark):
    got = one(
        spark, T.rank_of(F.lit("Subsp.")).alias("a"), T.rank_within(F.lit("family"), "order", "genus").alias("b"), T.rank_within(F.lit("unranked"), "order", "genus", True).alias("c"), T.ranks_agree(F.lit("species"), F.lit("unranked")).alias("d"),
        T.ranks_agree(F.lit("genus"), F.lit("subgenus")).alias("e"), T.ranks_agree(F.lit("genus"), F.lit("class")).alias("f"), T.statuses_agree(F.lit("synonym"), F.lit("proParteSynonym")).alias("g"), T.statuses_agree(F.lit("misapplied"), F.lit("accepted")).alias("h"),
        T.geographies_agree(F.lit("country"), F.lit("stateProvince")).alias("i"), T.geographies_agree(F.lit("country"), F.lit("island")).alias("j"), T.kingdom_fidelity(F.lit("fungi"), F.lit("Plantae")).alias("k"), T.rank_fidelity(F.lit(7000), F.lit(6000)).alias("l"),
        T.rank_fidelity(F.lit(8000), F.lit(8400)).alias("m"), T.geography_of(F.lit("Gulf")).alias("n"), T.accepts_synonym(F.lit("species"), F.lit("family")).alias("o"), T.code_of(F.lit("Virus")).alias("p"), T.placed(F.lit(None).cast("string")).alias("q"), T.synonym_like(F.lit("misapplied")).alias("r"),
    )
    assert tuple(got) == ("subspecies", True, True, None, True, False, True, False, True, False, 0.5, 0.0, 0.9, "waterBody", False, "ICVN", False, True)
    assert T.ranks(spark).count() == len(T.RANKS.splitlines())


def _result(id, p=0.95, status="accepted", name="n", **more):
    base = dict(id=id, name=name, rank="species", status=status, code="c", voucher=None, parent=None, accepted_id=id, accepted_name=name, accepted_rank="species", accepted_sound="s", accepted_parent=None, trail=["r"], weight=1.0, prior=0.1, evidence=0.1, conditional=0.9, posterior=p)
    return base | more


RULES = {
    0: ([_result("a", prior=0.95)], None),
    2: ([_result("a")], "a"),
    3: ([_result("a"), _result("b", code="d")], "a"),
    4: ([_result("a"), _result("b", 0.5, "miscellaneousLiterature")], "a"),
    5: ([_result("a", voucher="v"), _result("b")], "a"),
    6: ([_result("a"), _result("b", 0.9, "synonym", accepted_id="z")], "a"),
    7: ([_result("a", status="misapplied"), _result("b", status="misapplied")], "a"),
    8: ([_result("a", name="x"), _result("b", 0.5)], "a"),
    9: ([_result("a", name="x"), _result("b", status="unplaced")], "a"),
    10: ([_result("a", name="x", accepted_id="z"), _result("b", accepted_id="z")], "a"),
    11: ([_result("a", name="x"), _result("b", 0.9, "synonym", accepted_id="z")], "a"),
    12: ([_result("a", name="x", accepted_name="q"), _result("b", accepted_name="Q")], "a"),
    13: ([_result("a", name="x", accepted_name="q"), _result("b", accepted_name="w")], "a"),
    14: ([_result("a", 0.5, "synonym", "x", accepted_id="z", trail=["r", "g"]), _result("b", 0.5, "synonym", accepted_id="y", trail=["r", "g"])], "g"),
    15: ([_result("a", 0.5), _result("b", 0.5)], "a"),
    16: ([_result("a", 0.5, "unplaced"), _result("b", 0.5, None)], "a"),
}


def test_each_rule_settles_its_case(spark):
    rows = [(rule, "n", "genus" if rule == 14 else None, results) for rule, (results, _) in RULES.items()] + [(99, "n", None, [])]
    df = spark.createDataFrame(rows, f"case int, name string, up string, results array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in D.FIELDS.split(','))}>>")
    got = {r["case"]: r.decision for r in D.settle(df, "results", "name", "up").collect()}
    assert got[0] is None and got[99] is None
    for rule, (_, id) in RULES.items():
        if rule:
            assert (got[rule].rule, got[rule].id, got[rule].valid) == (rule, id, rule != 3), rule
    assert got[6].issues == ["accepted and synonym"] and math.isclose(got[6].posterior, 1 - 0.05 * 0.1)
    marks = df.where("case IN (6, 7)").select("case", D.marked(F.col("results")).alias("m")).collect()
    assert {r["case"]: [x.issues for x in r.m] for r in marks} == {6: [[], []], 7: [["misapplied"], ["misapplied"]]}


def test_order_against_insertion_sort(spark):
    rng = random.Random(5)
    status = [line.split()[0] for line in T.STATUSES.splitlines()]

    def compare(a, b):
        d = a["posterior"] - b["posterior"]
        s = status.index(a["status"]) - status.index(b["status"])
        if abs(d) < 0.10 and s:
            return s
        if abs(d) < 1e-5 and a["weight"] != b["weight"]:
            return -1 if a["weight"] > b["weight"] else 1
        return (d < 0) - (d > 0)

    # Where all are close or all are far apart the rule is an order, and every stable sort agrees.
    near = [_result(str(k), 0.9 + rng.random() / 1e6, rng.choice(status[:5]), weight=float(rng.randint(1, 3))) for k in range(12)]
    far = [_result(str(k), 0.05 + 0.11 * k, rng.choice(status)) for k in rng.sample(range(8), 8)]
    schema = f"results array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in D.FIELDS.split(','))}>>"
    got = spark.createDataFrame([(near,), (far,)], schema).select(D.in_order(F.col("results")).alias("o")).collect()
    for r, given in zip(got, (near, far)):
        assert [x.id for x in r.o] == [x["id"] for x in sorted(given, key=functools.cmp_to_key(compare))]


def test_changes(spark):
    df = spark.createDataFrame([("a", "Kangaroo", "Kangaroo", None, []), ("b", "King island", "x", "y", []), (None, None, None, None, [])], "id string, place string, down string, other string, issues array<string>")
    out = C.suffix("s", "place", " Island", ("down",), "suffixed").apply(df).collect()
    assert [(r.place, r.down, r.issues) for r in out] == [("Kangaroo Island", "Kangaroo Island", ["suffixed"]), ("King island", "x", []), (None, None, [])]
    assert [r.other for r in C.choose("c", "other", ["other", "place"]).apply(df).collect()] == ["Kangaroo", "y", None]
    assert [r.other for r in C.join("j", "other", ["place", "down"]).apply(df).collect()] == ["Kangaroo Kangaroo", "King island x", None]
    both = C.composite("b", [C.remove("r", ["place"], ("down",), "removed"), C.assign("a", "other", "z", where=F.col("other").isNull())])
    assert [(r.place, r.down, r.other, r.issues) for r in both.apply(df).collect()] == [(None, None, "z", ["removed"]), ("King island", "x", "y", []), (None, None, None, [])]


def test_waves_stop_and_number_trials(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, None, "q"), (3, "z", "q"), (4, "z", None)], "id int, a string, b string").withColumn("issues", F.array().cast("array<string>"))
    match = lambda t: t.where("coalesce(a, 'x') = 'x' AND coalesce(b, 'y') = 'y'").select("id")
    got = waves.in_waves(df, "id", match, [[C.remove("a", ["a"], issue="no a")], [C.remove("b", ["b"], issue="no b")]]).collect()
    assert {r.id: (r.trial, r.issues) for r in got} == {1: (0, []), 2: (1, ["no b"]), 3: (3, ["no a", "no b"]), 4: (2, ["no a"])}
    hints = spark.createDataFrame([(1, "x", ["p", "q"]), (2, "y", None)], "id int, k string, h array<string>")
    assert sorted((r.id, r.trial, r.k) for r in waves.hinted(hints, "id", {"k": "h"}).collect()) == [(1, 0, "x"), (1, 1, "p"), (1, 2, "q"), (2, 0, "y")]


def test_polygons_against_brute_force(spark):
    wkt = "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2)), ((20 0, 30 0, 25 10, 20 0)))"
    points = [(k, (k * 7 % 64) / 2 + 0.1, (k * 11 % 24) / 2 + 0.05) for k in range(150)] + [(900, None, 1.0)]

    def inside(x, y):
        square = 0 <= x < 10 and 0 <= y < 10 and not (2 <= x < 4 and 2 <= y < 4)
        return square or (0 <= y < 10 and 20 + y / 2 <= x < 30 - y / 2)

    df = spark.createDataFrame(points, "id int, x double, y double")
    areas = spark.createDataFrame([(2, None, wkt, 3.0), (1, None, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", 5.0), (3, None, "nonsense", 7.0)], "area_order int, area_location string, wkt string, boost double")
    got = {r.id: r.boost for r in matching.first_area(df, areas, "id", "x", "y", cell=4.0).collect()}
    for k, x, y in points:
        want = 1.0 if x is None else 5.0 if x < 1 and y < 1 else 3.0 if inside(x, y) else 1.0
        assert got[k] == want, (k, x, y)
    assert one(spark, G.contains(G.rings(F.lit("POINT (1 1)")), F.lit(1.0), F.lit(1.0)).alias("c")).c is None


def test_names_are_read_word_by_word(spark):
    want = {
        "\" 'Acacia dealbata' \"": ("Acacia dealbata", None, "scientific", []), "Acacia subsp. dealbata sp.": ("Acacia dealbata", "subspecies", "informal", ["rank ending", "rank marker"]),
        "Acacia cf dealbata aff.": ("Acacia cf. dealbata aff.", None, "informal", ["affinity", "confer"]), "sp.": (None, "unranked", "informal", ["rank ending"]),
        "Acacia sp. novum costata": ("Acacia sp. nov. costata", "species", "scientific", ["new species"]), "Acacia sp. Big Leaf": ("Acacia sp. Big Leaf", "species", "placeholder", ["phrase-like name"]),
        "Acacia sp. Big Leaf(J. Smith 12) x": ("Acacia sp. Big Leaf(J. Smith 12) x", "species", "phrase", ["phrase name"]), "Acacia sect. Poelia": ("Acacia Poelia", "section", "scientific", ["rank marker"]),
        "Acacia [sic] dealbata? hybrid": ("Acacia dealbata", None, "informal", ["comment", "indeterminate"]), "*": (None, None, "scientific", ["comment"]), '"': (None, None, "scientific", []),
    }
    df = spark.createDataFrame([(n, k, "kept") for k, n in enumerate(want)], "n string, row int, words string")
    out = N.analyse(df, "n")
    assert out.columns == ["n", "row", "words", "name", "rank", "kind", "issues"]
    assert {r.n: (r["name"], r["rank"], r.kind, r.issues) for r in out.collect()} == want
    assert N.analyse(df.limit(0), "n").collect() == []


def test_candidates_against_brute_force(spark):
    rng = random.Random(11)
    records = [(k, rng.choice(["a", "A", "b", None]), rng.choice(["x", "y", "z", None]), rng.randint(0, 3)) for k in range(200)]
    schema = "id int, f string, g string, h int"
    low = lambda r: [None if v is None else str(v).lower() for v in r[1:]]
    counts = {}
    for r in records:
        for j, v in enumerate(low(r)):
            counts[j, v] = counts.get((j, v), 0) + 1
    idf = lambda j, v: math.log(1 + (200 - counts[j, v] + 0.5) / (counts[j, v] + 0.5))
    df = spark.createDataFrame(records, schema)
    got = matching.candidates(df.where("id < 40").withColumnRenamed("id", "t"), df, ["f", "g", "h"], "t", "id", k=5).collect()
    for t in records[:40]:
        scored = []
        for r in records:
            shared = [idf(j, a) for j, (a, b) in enumerate(zip(low(t), low(r))) if a is not None and a == b]
            if shared:
                scored.append((-round(sum(shared), 9), r[0]))
        assert [i for _, i in sorted(scored)[:5]] == [r.id for r in sorted((r for r in got if r.t == t[0]), key=lambda r: r.rank)]


def test_candidates_over_many_nested_columns(spark):
    rng, rows = random.Random(3), []
    for k in range(400):
        family = rng.choice("ab")
        genus = family + rng.choice("xyz")
        rows.append((k, *[None if rng.random() < 0.05 else v for v in ("K", family, genus, genus + rng.choice("12"), *map(rng.choice, ("pq", "pqr", "st", "uv", "wW", "mn")))]))
    columns, low = [f"c{j}" for j in range(10)], lambda r: [None if v is None else v.lower() for v in r[1:]]
    counts = Counter((j, v) for r in rows for j, v in enumerate(low(r)))
    idf = lambda j, v: math.log(1 + (400 - counts[j, v] + 0.5) / (counts[j, v] + 0.5))
    df = spark.createDataFrame(rows, "id int" + "".join(f", {c} string" for c in columns))
    templates = df.where("id < 20").withColumnRenamed("id", "t").unionByName(spark.createDataFrame([(99, *["none"] * 10)], df.withColumnRenamed("id", "t").schema))
    got = matching.candidates(templates, df, columns, "t", "id", k=5).collect()
    assert not any(r.t == 99 for r in got)
    for t in rows[:20]:
        scored = [(-round(sum(shared), 9), r[0]) for r in rows if (shared := [idf(j, a) for j, (a, b) in enumerate(zip(low(t), low(r))) if a is not None and a == b])]
        assert [i for _, i in sorted(scored)[:5]] == [r.id for r in sorted((r for r in got if r.t == t[0]), key=lambda r: r["rank"])]


@pytest.mark.parametrize("copies", [1, 30])
def test_candidates_do_not_look_up_every_set_that_agrees(spark, monkeypatch, copies):
    written = []
    monkeypatch.setattr(matching, "cut", lambda df, real=matching.cut: (lambda out: written.append(out.count()) or out)(real(df)))
    rng, rows = random.Random(5), []
    for k in range(3000 // copies):
        rows.append((k, *[None if rng.random() < 0.03 else f"V{rng.randrange(m)}" for m in (3, 2, 5, 3, 4, 2, 3)], "all"))
    rows = [(i * 10000 + r[0], *r[1:]) for i in range(copies) for r in rows]
    columns = [f"c{j}" for j in range(8)]
    df = spark.createDataFrame(rows, "id long" + "".join(f", {c} string" for c in columns))
    counts = Counter((j, v) for r in rows for j, v in enumerate(r[1:]) if v is not None)
    idf = {x: math.log(1 + (len(rows) - c + 0.5) / (c + 0.5)) for x, c in counts.items()}
    got = {}
    for r in matching.candidates(df.where("id % 20 = 0").withColumnRenamed("id", "t"), df, columns, "t", "id", k=5).collect():
        got.setdefault(r.t, {})[r["rank"]] = r.id
    templates = [t for t in rows if t[0] % 20 == 0]
    assert set(got) == {t[0] for t in templates}
    for t in templates[::15]:
        scored = sorted((-round(sum(idf[j, a] for j, (a, b) in enumerate(zip(t[1:], r[1:])) if a is not None and a == b), 9), r[0]) for r in rows)
        assert [i for _, i in scored[:5]] == [got[t[0]][k] for k in range(1, 6)]
    assert sum(written) < 15 * len(rows), written


def test_signed_conditionals_known_and_blank(spark):
    rows = spark.createDataFrame([("rufus", "Osphranter", 70.0), ("dealbata", "Acacia", 100.0), ("abbreviata", "Acacia", 20.0), ("dealbata", "Montitega", 30.0), ("atropurpurea", "Agathis", 10.0), (None, "Agathis", 20.0)], "e string, g string, w double")
    got = {(r.g, r.e): (r.p_t, r.p_f) for r in parameters.signed_conditionals(rows, "g", ["e"], "w").collect()}
    assert math.isclose(got["Acacia", "abbreviata"][1], 0.43478260869565216) and math.isclose(got["Acacia", "dealbata"][0], 100 / 130)
    assert got["Agathis", None] == (1.0, 0.0) and got["Osphranter", "rufus"] == (1 - 1e-9, 1e-9)
    assert parameters.signed_conditionals(rows.limit(0), "g", ["e"], "w").collect() == []


def test_horizons_and_drawing():
    net = Network("n", list("ABCDE"), [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")])
    assert [net.horizon(v) for v in "ABCD"] == [(["D"], ["B", "C"]), (["D"], []), (["D"], []), (["E"], [])]
    net = Network("n", ["v1", "v2", "v3"], [("v1", "v2"), ("v2", "v3"), ("v1", "v3")], {"v2": "g"})
    assert [net.horizon(v) for v in net.vertices] == [(["v3"], ["v2"]), (["v3"], []), ([], [])]
    assert net.sources() == {"v3"} and Network.read(net.json()) == net and '"v1" -> "v2";' in net.dot() and "cluster_g" in net.dot(full=True)
    assert net.derivation_order({"v1": ["v3"], "v3": []}) == ["v3", "v1"]


def test_program_by_signature(spark):
    net = Network("n", ["a", "b"], [("a", "b")], {"b": "g"})
    given = {"T": {"prior_a": F.lit(0.2), "inf_b_t$t": F.lit(0.9), "inf_b_t$f": F.lit(0.1)}, "F": {"prior_a": F.lit(0.2)}}
    df = spark.createDataFrame([("T", True), ("F", None)], "s string, b boolean")
    out = net.by_signature(F.col("s"), "a", {"b": F.col("b")}, given, ["T", "F"])
    assert [round(r.p, 6) for r in df.select(out["posterior"].alias("p")).collect()] == [round(0.18 / 0.26, 6), 0.2]
    with pytest.raises(Exception, match="unknown signature"):
        spark.createDataFrame([("X", None)], "s string, b boolean").select(out["posterior"].alias("p")).collect()


def test_broadening_prunes_and_rejects_loops(spark):
    nodes = spark.createDataFrame([(1, None, "A", True), (2, 1, "B", False), (3, 2, "C", True), (4, 3, "D", True), (9, 8, "E", True)], "id long, parent long, name string, ok boolean")
    up = {r.id: r.names for r in hierarchy.broaden(nodes, "id", "parent", "name", F.col("ok")).collect()}
    down = {r.id: r.names for r in hierarchy.broaden(nodes, "id", "parent", "name", F.col("ok"), up=False).collect()}
    assert up == {1: [], 2: ["A"], 3: [], 4: ["C"], 9: []} and down == {1: [], 2: ["C", "D"], 3: ["D"], 4: [], 9: []}
    with pytest.raises(ValueError):
        hierarchy.broaden(spark.createDataFrame([(1, 2, "A"), (2, 1, "B")], "id long, parent long, name string"), "id", "parent", "name", F.lit(True), max_depth=4)


def test_suggestions_against_brute_force(spark):
    names = [("Malva preissiana", 2.0), ("Acacia", 1.0), ("Acácia alba", 1.0), ("ac", 1.0)]
    df = spark.createDataFrame(names, "name string, weight double")
    asked = ["preiss", "acac", "AC", "zzz", "a"]
    got = matching.suggest(df, spark.createDataFrame([(a,) for a in asked], "fragment string")).collect()
    plain = lambda s: s.lower().replace("á", "a")
    for a in asked:
        hits = [(n, _lcs(plain(a), plain(n)) * w) for n, w in names if (plain(a) in plain(n) if len(a) >= 3 else plain(a) == plain(n))]
        assert sorted((r["name"], round(r.score, 9)) for r in got if r.fragment == a) == sorted((n, round(s, 9)) for n, s in hits)


def test_tristate_match(spark):
    same = lambda a, b: F.when(F.length(b) > 0, a == b)
    variants = lambda v: F.lit(None).cast("array<string>") if v is None else F.array(*[F.lit(x) for x in v]).cast("array<string>")
    cases = [("a", ["a", None], True), ("a", ["b", None], False), ("a", [None], None), ("a", [], None), ("a", None, None), (None, ["a"], None), ("a", [""], None)]
    got = one(spark, *[matching.matched_any(F.lit(g).cast("string"), variants(v), same).alias(f"c{k}") for k, (g, v, _) in enumerate(cases)])
    assert list(got) == [w for *_, w in cases]


def test_stream_of_templates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("a", 7)], "k string, r int")
    stream = spark.readStream.schema("id int, k string").parquet(str(tmp_path / "in"))
    q = match_stream(stream, lambda t: t.join(known, "k").select("id", "r"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert [(r.id, r.r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 7)]


def test_documents(spark, tmp_path):
    xml = '<e:eml xmlns:e="x" packageId="p"><dataset><title> A  b </title><creator><individualName><givenName>G</givenName><surName>S</surName></individualName></creator><abstract><para>t</para></abstract></dataset></e:eml>'
    assert documents.dataset_metadata(xml) == {"identifier": "p", "title": "A b", "about": "t", "creators": [{"name": "G S"}]}
    assert documents.merged({"a": 1, "sources": [{"identifier": "x", "t": 1}]}, {"a": None, "b": 2, "sources": [{"identifier": "x", "t": 2}]}) == {"a": 1, "b": 2, "sources": [{"identifier": "x", "t": 2}]}
    documents.write_settings(str(tmp_path / "index"), spark, network={"id": "n"}, metadata={"v": 1})
    assert documents.read_setting(str(tmp_path / "index"), spark, "network") == {"id": "n"}
    df = spark.createDataFrame([("b", "x", "d"), ("a", None, "d")], "name string, p string, q string")
    documents.write_special_cases(df, str(tmp_path / "cases"), defaults={"q": "d"})
    back = documents.read_special_cases(spark, str(tmp_path / "cases"))
    assert back.columns == ["name", "p"] and [r["name"] for r in back.collect()] == ["a", "b"]
    documents.write_special_cases(df.union(df), str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="given twice"):
        documents.read_special_cases(spark, str(tmp_path / "twice"))
    t = documents.as_templates(spark.createDataFrame([("1", "2", "3")], ["http://e/terms/Genus", "taxon", "extra"]), {"genus_id": "http://f/genus", "taxon": "http://f/t"})
    assert t.columns == ["genus_id", "taxon", "extra"]
    r = documents.report(spark.createDataFrame([("x", ["i"])], "g string, issues array<string>"), ["g"], {"ok": F.lit(True)}, "issues", ["i", "j"])
    assert r.columns == ["Supplied g", "ok", "i", "j"] and tuple(r.first()) == ("x", True, True, False)
    assert documents.is_current(5, [1, 5]) and not documents.is_current(5, [6])


def test_every_query_of_the_catalogue_runs_on_small_tables(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
