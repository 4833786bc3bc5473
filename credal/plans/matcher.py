"""Match control: templates go from stage to stage until one of them settles them.

Directly; then with changes, where all results are of bad evidence; then with hints; then, with candidates looked up afresh, with changes of
the template itself, each of them through the same stages. Every stage works on all templates that are still open, as one batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credal.functions.taxonomy import synonym_like
from credal.operators import decisions, matching
from credal.operators.conditions import Change
from credal.operators.hierarchy import resolve_accepted
from credal.operators.lineage import cut, tidy
from credal.operators.waves import hinted, trials_of
from credal.plans.resolver import Model, looked_up, paired, scored

#: The fields of a result that come from its record, not from its accepted record or from the inference.
RECORD_FIELDS = ("name", "rank", "status", "code", "voucher", "parent", "trail", "weight")


def possible(least: Column | float = 0.05) -> Column:
    """Results that are possible at all: a posterior of at least 0.05, and evidence that speaks for the record rather than against it."""
    return (F.col("posterior") >= least) & (F.col("conditional") >= F.col("evidence"))


def possible_taxon(status: str = "status") -> Column:
    """As ``possible``; a tenth of the posterior is enough for what is like a synonym."""
    return possible(F.when(synonym_like(F.col(status)), 0.005).otherwise(0.05))


@dataclass(frozen=True)
class Control:
    """What the stages do.

    prepare: derives what a template lacks, before candidates are looked up. valid: of given_<vertex> and the index's columns, which candidates are
    looked at. possible: of the index's columns kept and the probabilities, which results count. match_changes, hints (column: an array
    column of values to try), source_changes: what is tried, in order. fields: for the taxon list, the index's columns by the names of
    ``RECORD_FIELDS``; without it a result is settled by the general rule (immediate, else the only acceptable). name: the template's
    column that is compared with records' names in the taxon list.
    """

    model: Model
    prepare: Callable[[DataFrame], DataFrame] | None = None
    valid: Column | None = None
    possible: Column = field(default_factory=possible)
    match_changes: tuple[tuple[Change, ...], ...] = ()
    hints: dict[str, str] = field(default_factory=dict)
    source_changes: tuple[tuple[Change, ...], ...] = ()
    fields: dict[str, str] | None = None
    name: str | None = None


def _general(c: Control, results: DataFrame, cases: DataFrame, index: DataFrame) -> DataFrame:
    h = c.model.hypothesis
    fine = results.where(~matching.bad_evidence(F.col("prior"), F.col("evidence"), F.col("conditional")))
    one = matching.single(fine, "case", h).where("matched IS NOT NULL").withColumnRenamed("case", "_case")
    p = fine.select("case", h, "posterior")
    found = one.join(p, (F.col("case") == F.col("_case")) & (F.col(h) == F.col("matched")))
    return found.select("case", "matched", "outcome", "posterior", F.lit(True).alias("valid"), F.array().cast("array<string>").alias("found_issues"))


def _taxa(c: Control, results: DataFrame, cases: DataFrame, index: DataFrame) -> DataFrame:
    """The taxon list over each case's results, which the number of candidates bounds. Ties go to the smaller id. The rank of
    the common ancestor is looked up in the index."""
    h, rank = c.model.hypothesis, c.fields["rank"]
    one = F.struct(*[F.col("result")[n].alias(n) if n not in ("prior", "evidence", "conditional", "posterior") else F.col(n) for n in (f.split()[0] for f in decisions.FIELDS.split(", "))])
    every = results.groupBy("case").agg(F.array_sort(F.collect_list(one)).alias("results")).join(cases.select("case", F.col(c.name).alias("asked")), "case")
    every = every.withColumns({"results": decisions.marked(decisions.in_order(F.col("results"))), "up": decisions.common_ancestor(decisions.usable(F.col("results")))})
    ranks = index.select(F.col(h).cast("string").alias("_up"), F.col(rank).alias("up_rank"))
    settled = decisions.settle(every.join(ranks, F.col("up") == F.col("_up"), "left"), "results", "asked", "up_rank").where("decision IS NOT NULL")
    chosen = F.get(F.filter("results", lambda x: x["id"] == F.col("decision.id")), F.lit(0))
    own = F.coalesce(chosen["issues"], F.array().cast("array<string>"))
    matched = F.col("decision.id").cast(index.schema[h].dataType)
    return settled.select("case", matched.alias("matched"), F.concat(F.lit("rule "), F.col("decision.rule")).alias("outcome"), F.col("decision.posterior").alias("posterior"), F.col("decision.valid").alias("valid"), F.array_union(own, F.col("decision.issues")).alias("found_issues"))


def _with_results(c: Control, index: DataFrame, accepted: DataFrame) -> DataFrame:
    """The index with each record's part of a result: its own fields and those of its accepted record."""
    h, f = c.model.hypothesis, c.fields
    column = lambda n, at="": F.col(f"{at}{f[n]}") if n in f else F.lit(None)
    held = [n for n in ("name", "rank", "parent", "trail") if n in f] + (["sound"] if "sound" in f else [])
    above = accepted.join(index.select(F.col(h).alias("_of"), *[F.col(f[n]).alias(f"up_{n}") for n in held]), F.col("accepted") == F.col("_of"), "left").drop("_of")
    up = lambda n: F.col(f"up_{n}") if n in held else F.lit(None)
    types = {x.split()[0]: x.split()[1] for x in decisions.FIELDS.split(", ")}
    made = {n: column(n) for n in RECORD_FIELDS if n != "trail"} | {"id": F.col(h), "trail": up("trail"), "accepted_id": F.col("accepted")} | {f"accepted_{n}": up(n) for n in ("name", "rank", "sound", "parent")}
    result = F.struct(*[e.cast(types[n]).alias(n) for n, e in made.items()])
    return cut(index.join(above.withColumnRenamed("_id", "_record"), F.col(h) == F.col("_record")).withColumn("result", result).select(*index.columns, "result"))


def _tried(cases: DataFrame, steps: list[Change]) -> DataFrame:
    """The cases that any of the changes touches, changed."""
    guard = F.lit(False)
    for s in steps:
        guard = guard | F.coalesce(s.guard, F.lit(False))
    out = cases.where(guard)
    for s in steps:
        out = s.apply(out)
    return out


def _without(cases: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return cases.join(gone.select(F.col(key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


@tidy("matches")
def match(c: Control, index: DataFrame, templates: DataFrame, template_id: str) -> DataFrame:
    """template_id, matched, accepted, outcome, posterior, valid, issues, stage: one row for each template that a stage settles.

    Template ids are distinct; templates without one are left out. Templates that give the same in all their columns are matched once. stage says where: source (number of the change of the template, 0 for none), hint (number of the choice
    of hints, 0 for none) and change (number of the change, 0 for none). A match that is not valid (a homonym) counts only if no later stage
    gives a valid one; of several the first counts. Templates without any match are not returned; empty tables give no rows.
    """
    h = c.model.hypothesis
    stands = F.col(c.model.accepted) if c.model.accepted else F.lit(None).cast(index.schema[h].dataType)
    accepted = cut(resolve_accepted(index.select(h, stands.alias("_stands")), h, "_stands").select(F.col(h).alias("_id"), "accepted"))
    whole, decide = (index, _general) if c.fields is None else (_with_results(c, index, accepted), _taxa)
    keep = [x for x in whole.columns if x not in (h, "prior", "weight", "signature") and "|" not in x]
    parts: list[DataFrame] = []

    def settled(cases: DataFrame, candidates: DataFrame, source: int, change: int) -> tuple[DataFrame, DataFrame]:
        """The cases' matches, and the cases with a result that is not of bad evidence."""
        pairs = paired(c.model, candidates.join(cases.select("case", "template"), "template").drop("template"), cases, "case")
        results = cut(scored(c.model, whole, pairs, "case", c.valid, keep).where(c.possible))
        stage = F.struct(F.lit(source).alias("source"), F.col("case.hint").alias("hint"), F.lit(change).alias("change"))
        out = decide(c, results, cases, whole).join(cases.select(F.col("case").alias("_case"), "issues"), F.col("case") == F.col("_case")).drop("_case")
        out = cut(out.select("case", "matched", "outcome", "posterior", "valid", F.array_union("issues", "found_issues").alias("issues"), stage.alias("stage")))
        parts.append(out)
        return out.where("valid"), results.where(~matching.bad_evidence(F.col("prior"), F.col("evidence"), F.col("conditional")))

    def find(cases: DataFrame, candidates: DataFrame, source: int) -> DataFrame:
        """The cases that are still open."""
        found, fine = settled(cases, candidates, source, 0)
        left = cut(_without(cases, found, "case"))
        if not c.match_changes or left.isEmpty():
            return left
        bad = cut(_without(left, fine, "case"))
        for number, steps in enumerate(trials_of([list(x) for x in c.match_changes])[1:], 1):
            tried = cut(_tried(bad, steps))
            if tried.isEmpty():
                continue
            found, _ = settled(tried, candidates, source, number)
            bad, left = cut(_without(bad, found, "case")), cut(_without(left, found, "case"))
        return left

    def search(rows: DataFrame, source: int) -> None:
        rows = cut(c.prepare(rows) if c.prepare else rows)
        candidates = cut(looked_up(c.model, whole, rows, "template").select("template", h))
        case = lambda n: F.struct("template", n.cast("long").alias("hint"))
        cases = rows.join(candidates.select("template").distinct(), "template", "left_semi").withColumn("case", case(F.lit(0)))
        left = find(cut(cases), candidates, source)
        if c.hints and not left.isEmpty():
            tried = hinted(left, "case", c.hints).where("trial > 0").withColumn("case", case(F.col("trial"))).drop("trial")
            find(cut(tried), candidates, source)

    # Templates that give the same are matched once, under the digest of what they give.
    given = [x for x in templates.columns if x != template_id]
    keyed = cut(templates.where(F.col(template_id).isNotNull()).withColumn("template", F.sha2(F.to_json(F.struct(*given)), 256)))
    open_ = keyed.groupBy("template").agg(F.any_value(F.struct(*given)).alias("given")).select("template", "given.*")
    open_ = cut(open_ if "issues" in open_.columns else open_.withColumn("issues", F.array().cast("array<string>")))
    for number, steps in enumerate(trials_of([list(x) for x in c.source_changes])):
        rows = cut(_tried(open_, steps)) if steps else open_
        if steps and rows.isEmpty():
            continue
        search(rows, number)
        done = parts[0].where("valid")
        for x in parts[1:]:
            done = done.unionByName(x.where("valid"))
        open_ = cut(_without(open_, done.select(F.col("case.template").alias("template")), "template"))
        if open_.isEmpty():
            break
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    fields = ("matched", "outcome", "posterior", "valid", "issues", "stage")
    first = every.groupBy("case.template").agg(F.min_by(F.struct(*fields), F.struct(~F.col("valid"), "stage")).alias("m")).select("template", "m.*")
    out = keyed.select(template_id, F.col("template").alias("_key")).join(first, F.col("_key") == F.col("template"))
    return out.join(accepted, F.col("matched") == F.col("_id"), "left").select(template_id, "matched", "accepted", "outcome", "posterior", "valid", "issues", "stage")


def estimated(c: Control, index: DataFrame, templates: DataFrame, template_id: str, levels: list[tuple[str, str]], name: str, rank: str, wanted: str) -> DataFrame:
    """Templates with estimated: what the accepted record of a template's higher names has in the index's column ``wanted``; null where the
    template gives it itself or no level finds any.

    levels: columns of the templates with the rank of their names, the most specific first. Each distinct (name, rank) is matched once.
    """
    key = lambda n, r: F.concat_ws("|", F.lit(r), F.lower(n))
    open_ = templates.where(F.col(wanted).isNull()) if wanted in templates.columns else templates
    keys = F.array(*[F.when(F.col(n).isNotNull(), F.struct(key(F.col(n), r).alias("asked"), F.lower(F.col(n)).alias("name"), F.lit(r).alias("rank"))) for n, r in levels])
    asked = cut(open_.select(F.col(template_id).alias("_t"), F.posexplode(keys).alias("level", "k")).where("k IS NOT NULL").select("_t", "level", "k.*"))
    once = asked.groupBy("asked").agg(F.first("name").alias("_name"), F.first("rank").alias("_rank"))
    empty = [F.lit(None).cast(index.schema[v].dataType).alias(v) for v in c.model.observed() if v not in (name, rank)]
    found = match(c, index, once.select("asked", F.col("_name").alias(name), F.col("_rank").alias(rank), *empty), "asked").where("valid")
    of = index.select(F.col(c.model.hypothesis).alias("_id"), F.col(wanted).alias("_wanted")).where("_wanted IS NOT NULL")
    values = found.select("asked", "accepted").join(of, F.col("accepted") == F.col("_id")).select("asked", "_wanted")
    best = asked.join(values, "asked").groupBy("_t").agg(F.min_by("_wanted", "level").alias("estimated"))
    return templates.join(best, F.col(template_id) == F.col("_t"), "left").drop("_t")
