"""Results of one template put in order, marked with issues, and settled to one match.

``results`` is an array of at most 31 structs a template (the candidate limit bounds it), with the fields of ``FIELDS``. Fields may be null:
a null status counts as unknown, null probabilities as 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credal.functions.taxonomy import placed, rank_id, status_is, status_order, synonym_like
from credal.operators.matching import acceptable, bad_evidence

#: A result: the matched record, its accepted record, and its probabilities.
FIELDS = (
    "id string, name string, rank string, status string, code string, voucher string, parent string, accepted_id string, accepted_name string, accepted_rank string, "
    "accepted_sound string, accepted_parent string, trail array<string>, weight double, prior double, evidence double, conditional double, posterior double"
)


def _p(x: Column) -> Column:
    return F.coalesce(x["posterior"], F.lit(0.0))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def in_order(results: Column) -> Column:
    """Results by posterior, greatest first; under 0.10 apart by status, and of one status and under 1e-5 apart by weight.

    That rule is not transitive: the order is the one a stable insertion sort gives.
    """

    def compare(a: Column, b: Column) -> Column:
        apart = _p(a) - _p(b)
        by_status = status_order(a["status"]) - status_order(b["status"])
        by_weight = F.coalesce(b["weight"], F.lit(1.0)) - F.coalesce(a["weight"], F.lit(1.0))
        sign = lambda c: F.signum(c.cast("double")).cast("int")
        return F.when((F.abs(apart) < 0.10) & (by_status != 0), sign(by_status)).when((F.abs(apart) < 1e-5) & (by_weight != 0), sign(by_weight)).otherwise(sign(-apart))

    return F.array_sort(results, compare)


def marked(results: Column) -> Column:
    """Results with issues: misapplied, excluded, partially misapplied, partially excluded, parent-child synonym, in this order."""

    def one(x: Column) -> Column:
        others = F.filter(results, lambda y: (y["id"] != x["id"]) & _same(y["name"], x["name"]))
        sits = placed(x["status"])
        found = [
            (status_is(x["status"], "M"), "misapplied"), (status_is(x["status"], "E"), "excluded"),
            (sits & F.exists(others, lambda y: status_is(y["status"], "M")), "partially misapplied"), (sits & F.exists(others, lambda y: status_is(y["status"], "E")), "partially excluded"),
            (F.exists(others, lambda y: synonym_like(y["status"]) & F.coalesce(y["accepted_parent"] == x["id"], F.lit(False))), "parent-child synonym"),
        ]
        return x.withField("issues", F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for c, n in found]), lambda i: i.isNotNull()))

    return F.transform(results, one)


def homonym(results: Column, name: Column) -> Column:
    """Whether accepted results with the template's name are of more than one nomenclatural code."""
    codes = F.transform(F.filter(results, lambda x: status_is(x["status"], "A") & _same(x["name"], name) & x["code"].isNotNull()), lambda x: x["code"])
    return F.size(F.array_distinct(codes)) > 1


def common_ancestor(results: Column) -> Column:
    """The last id of the longest common prefix of the accepted records' trails (each with the record itself); null if there is none.

    A prefix of the least and of the greatest trail is one of all between, so two trails are compared.
    """
    paths = F.transform(results, lambda x: F.concat(F.coalesce(x["trail"], F.array().cast("array<string>")), F.array(x["accepted_id"])))
    low, high = F.array_min(paths), F.array_max(paths)
    n = F.least(F.size(low), F.size(high))
    depth = F.array_max(F.transform(F.sequence(F.lit(0), n), lambda k: F.when(F.slice(low, F.lit(1), k) == F.slice(high, F.lit(1), k), k).otherwise(0)))
    return F.when((F.size(results) > 0) & (depth > 0), F.element_at(low, F.greatest(depth, F.lit(1))))


def boosted(results: Column) -> Column:
    """The probability that one of the results is right."""
    return 1 - F.aggregate(results, F.lit(1.0), lambda acc, x: acc * (1 - _p(x)))


def usable(results: Column) -> Column:
    """Results without those of bad evidence."""
    return F.filter(results, lambda x: ~F.coalesce(bad_evidence(x["prior"], x["evidence"], x["conditional"]), F.lit(False)))


def settle(df: DataFrame, results: str, name: str, ancestor_rank: str | None = None) -> DataFrame:
    """Adds decision: the struct (rule, id, posterior, valid, issues) of the first rule of the taxon list that holds; null for none.

    Results need not be sorted. Rules see results without those of bad evidence. ``ancestor_rank`` names a column with the rank of
    ``common_ancestor(usable(results))``; without it the rule of a common ancestor above them all never holds.
    """
    out = df.withColumn("_all", in_order(usable(F.col(results)))).withColumn("_ok", F.filter("_all", lambda x: F.coalesce(acceptable(x["posterior"], x["evidence"], x["conditional"]), F.lit(False))))
    every, ok = F.col("_all"), F.col("_ok")
    out = out.withColumns({"_first": F.get(every, F.lit(0)), "_best": F.get(ok, F.lit(0)), "_rest": F.slice(every, 2, 64), "_others": F.slice(ok, 2, 64), "_up": common_ancestor(every)})
    first, best, rest, others, up = (F.col(c) for c in ("_first", "_best", "_rest", "_others", "_up"))
    misc = lambda x: F.coalesce(x["status"] == "miscellaneousLiterature", F.lit(False))
    accepted_id = lambda x: F.coalesce(x["accepted_id"], x["id"])
    equal = lambda a, b: F.coalesce(a == b, F.lit(False))
    wrong = lambda x: status_is(x["status"], "M")
    n_ok = F.size(ok)
    high = F.lit(False) if ancestor_rank is None else F.coalesce(rank_id(F.col(ancestor_rank)) > 3000, F.lit(False))
    none = F.array().cast("array<string>")

    def take(rule: int, x: Column, p: Column, *issues: str, valid: bool = True, more: Column = none) -> Column:
        return F.struct(F.lit(rule).alias("rule"), x.alias("id"), p.alias("posterior"), F.lit(valid).alias("valid"), F.concat(F.array(*map(F.lit, issues)) if issues else none, more).alias("issues"))

    all_boost, several = boosted(every), "multiple matches"
    to_first = F.forall(rest, lambda x: equal(accepted_id(x), first["id"]))
    rules = [
        (F.size(every) == 1, take(2, first["id"], _p(first))),
        (homonym(every, F.col(name)), take(3, first["id"], _p(first), "unresolved homonym", valid=False)),
        (~misc(first) & F.forall(rest, misc), take(4, first["id"], all_boost, several)),
        (first["voucher"].isNotNull() & F.forall(rest, lambda x: x["voucher"].isNull()), take(5, first["id"], all_boost, several)),
        (status_is(first["status"], "A") & F.forall(rest, lambda x: synonym_like(x["status"]) & _same(x["name"], first["name"])), take(6, first["id"], all_boost, more=F.when(to_first, none).otherwise(F.array(F.lit("accepted and synonym"))))),
        (wrong(first) & F.forall(rest, lambda x: wrong(x) & _same(x["name"], first["name"])), take(7, first["id"], all_boost, "misapplied")),
        (n_ok == 1, take(8, best["id"], _p(best))),
        ((n_ok > 1) & placed(best["status"]) & F.forall(others, lambda x: ~placed(x["status"])), take(9, best["id"], _p(best))),
        ((n_ok > 1) & F.forall(others, lambda x: equal(accepted_id(x), accepted_id(best))), take(10, best["id"], _p(best))),
        ((n_ok > 1) & status_is(best["status"], "A") & F.forall(others, lambda x: synonym_like(x["status"])), take(11, best["id"], boosted(ok), "accepted and synonym")),
        ((n_ok > 1) & F.forall(others, lambda x: _same(x["accepted_name"], best["accepted_name"]) & equal(x["accepted_rank"], best["accepted_rank"])), take(12, best["id"], _p(best), several)),
        ((n_ok > 1) & F.forall(others, lambda x: equal(x["accepted_sound"], best["accepted_sound"]) & equal(x["accepted_rank"], best["accepted_rank"])), take(13, best["id"], _p(best), several, "misspelled name")),
        (F.forall(every, lambda x: accepted_id(x) != x["id"]) & up.isNotNull() & high, take(14, up, all_boost, "synthetic match")),
        (F.forall(every, lambda x: status_is(x["status"], "A") & _same(x["name"], first["name"])), take(15, first["id"], _p(first), "unresolved homonym")),
        (F.forall(every, lambda x: status_is(x["status"], "D") & _same(x["name"], first["name"])), take(16, first["id"], _p(first), several)),
    ]
    chosen = reduce(lambda acc, r: F.when(F.coalesce(r[0], F.lit(False)), r[1]).otherwise(acc), reversed(rules), F.lit(None))
    return out.withColumn("decision", F.when(F.size(every) > 0, chosen)).drop("_all", "_ok", "_first", "_best", "_rest", "_others", "_up")


def only_or_first(results: Column, usable: Column | None = None) -> Column:
    """The rule of common names and places: the first of the sorted results whose posterior is acceptable, else the first; null for none."""
    ordered = F.array_sort(results, lambda a, b: F.signum(_p(b) - _p(a)).cast("int"))
    good = F.filter(ordered, lambda x: F.coalesce(acceptable(x["posterior"], x["evidence"], x["conditional"]), F.lit(False)))
    return F.coalesce(F.get(good, F.lit(0)), F.get(ordered, F.lit(0)))


def compared(new: dict[str, Column], old: dict[str, Column]) -> Column:
    """The class of a new result against an old one, first that holds.

    new: id, trail, kingdom, name, accepted_by (its accepted id, if a synonym), issues, alone (the id found without a place); old: id, trail,
    kingdom, name, synonym, parent.
    """
    n, o = new["id"], old["id"]
    both = n.isNotNull() & o.isNotNull()
    true = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(n.eqNullSafe(o), "same")
        .when(o.isNull(), "found")
        .when(n.isNull(), F.when(new["alone"].isNotNull(), "location").otherwise("notFound"))
        .when(both & true(F.array_contains(new["trail"], o)), "lowerRank")
        .when(both & ~true(F.array_contains(new["issues"], F.lit("higher order match"))) & new["accepted_by"].isNotNull() & ~true(old["synonym"]), "foundSynonym")
        .when(both & true(old["synonym"]) & true(old["parent"] == n), "parentChild")
        .when(both & true(new["alone"] == o), "location")
        .when(both & true(F.array_contains(old["trail"], n)), "higherRank")
        .when(~new["kingdom"].eqNullSafe(old["kingdom"]), "kingdom")
        .when(true(new["name"] == old["name"]), "sameName")
        .otherwise("other")
    )
