"""From records to matches: an index with its parameters, and batches of templates resolved against it."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credal.operators import matching, parameters
from credal.operators.conditions import Change
from credal.operators.hierarchy import resolve_accepted
from credal.operators.lineage import cut
from credal.operators.waves import in_waves
from credal.plans.network import Network


@dataclass(frozen=True)
class Model:
    """A network whose hypothesis is the record's id; every other vertex is a column of records and templates under the same name."""

    network: Network
    hypothesis: str
    weight: str = "weight"
    accepted: str | None = None
    candidates: int = 20

    def observed(self) -> list[str]:
        return [v for v in self.network.vertices if v != self.hypothesis]

    def groups(self) -> dict[str, list[str]]:
        """The vertices that come and go together, by the network's groups in order; a vertex without a group is one of its own."""
        out: dict[str, list[str]] = {}
        for v in self.network.ordered():
            if v != self.hypothesis:
                out.setdefault(self.network.groups.get(v, v), []).append(v)
        return out

    def sub(self, signature: str) -> Network:
        """The network without the groups whose place (in the order of ``groups``) is F."""
        whole = Network(self.network.id, self.network.vertices, self.network.edges, {v: g for g, held in self.groups().items() for v in held})
        return whole.erase({g for g, bit in zip(self.groups(), signature) if bit == "F"})


def build(model: Model, records: DataFrame) -> DataFrame:
    """The index: records with weight (null: 1), prior, signature and the parameters ``<vertex>|<parents>|<signs>`` that their signature needs.

    records have distinct ids under the hypothesis's name. The signature marks the groups of vertices of which a record has any; others are
    erased from its network, and edges go on to what follows. A vertex without a value in a group that is there is certain whatever is above
    it, and left out of the sums of what is below it. Each distinct (vertex, parents) among the signatures that occur is one table of sums over
    distinct values, joined once; so the number of joins follows the network. A supposed record is one: with it, its value is certain where
    all other parents agree; without it, its own weight is taken from the sums.
    """
    h, w = model.hypothesis, model.weight
    rows = records.withColumn(w, F.coalesce(F.col(w).cast("double"), F.lit(1.0)))
    rows = rows.withColumn("signature", matching.signature([[F.col(v) for v in held] for held in model.groups().values()]))
    total = rows.agg(F.sum(w).alias("_total"))
    out = cut(rows.crossJoin(F.broadcast(total)).withColumn("prior", parameters.clamp(F.col(w) / F.col("_total"))).drop("_total"))
    needed: dict[tuple[str, tuple[str, ...]], None] = {}
    for s in signatures(out):
        net = model.sub(s)
        needed |= {(v, tuple(net.parents(v))): None for v in net.ordered() if v != h}
    for v, above in needed:
        others = [x for x in above if x != h]
        sums = parameters.signed_weights(out, v, others, w)
        sums = sums.select(*[F.col(c).alias(f"_{c}") if c in (v, *others) else F.col(c) for c in sums.columns])
        same = F.lit(True)
        for c in (v, *others):
            same = same & (F.col(c).eqNullSafe(F.col(f"_{c}")) if c != v else F.col(c) == F.col(f"_{c}"))
        joined = out.join(sums, same, "left")
        made = {}
        for signs in itertools.product((True, False), repeat=len(above)):
            at = dict(zip(above, signs))
            name = parameters.sign_name(tuple(at[x] for x in others))
            own = F.col(w) if h in at and all(at[x] for x in others) else F.lit(0.0)
            p = parameters.own_conditional(own, F.col(f"b_{name}"), F.col(f"g_{name}"))
            if at.get(h):
                p = parameters.clamp(F.lit(1.0 if all(at[x] for x in others) else 0.0))
            made[column(v, above, signs)] = F.when(F.col(v).isNotNull(), p).otherwise(1.0)
        out = cut(joined.withColumns(made).select(*out.columns, *[f"`{c}`" for c in made]))
    return out


def column(v: str, above: tuple[str, ...], signs: tuple[bool, ...]) -> str:
    """The name of a parameter's column."""
    return f"{v}|{'+'.join(above)}|{parameters.sign_name(signs)}"


def signatures(index: DataFrame) -> list[str]:
    """The signatures that occur: at most 2 to the number of groups; more than 1,024 are an error."""
    found = [r.signature for r in index.select("signature").distinct().limit(1025).collect()]
    if len(found) > 1024:
        raise ValueError("more than 1,024 signatures: put vertices into groups")
    return sorted(found)


def score(model: Model, index: DataFrame, templates: DataFrame, template_id: str) -> DataFrame:
    """Candidates of each template with prior, evidence, conditional, posterior, fidelity, score and rank.

    A template's value is compared in any case; null on either side leaves the vertex open.
    """
    return scored(model, index, paired(model, looked_up(model, index, templates, template_id), templates, template_id), template_id)


def looked_up(model: Model, index: DataFrame, templates: DataFrame, template_id: str) -> DataFrame:
    """Each template's candidates: template_id, the record's id, score, rank."""
    return matching.candidates(templates, index.select(model.hypothesis, *model.observed()), model.observed(), template_id, model.hypothesis, model.candidates)


def paired(model: Model, found: DataFrame, templates: DataFrame, template_id: str) -> DataFrame:
    """Candidates with what their templates give, as given_<vertex>."""
    given = templates.select(F.col(template_id).alias("_t"), *[F.col(v).alias(f"given_{v}") for v in model.observed()])
    return found.join(given, F.col(template_id) == F.col("_t")).drop("_t")


def scored(model: Model, index: DataFrame, pairs: DataFrame, key: str, valid: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """pairs (key, the record's id, given_<vertex>, perhaps score and rank) with the probabilities of their records, and the columns of the index to keep.

    ``valid`` says of the given values and the record's columns which pairs are looked at. Pairs are written once, then those of each
    signature run its network's program.
    """
    seen, h = model.observed(), model.hypothesis
    places = [x for x in ("score", "rank") if x in pairs.columns]
    pairs = pairs.join(index, h)
    pairs = pairs if valid is None else pairs.where(valid)
    pairs = cut(pairs.withColumns({f"_seen_{v}": matching.agrees(F.col(f"given_{v}").cast("string"), F.col(v).cast("string")) for v in seen}))
    out = None
    for s in signatures(index):
        net = model.sub(s)
        values = {}
        for v in net.ordered():
            above = tuple(net.parents(v))
            if v != h:
                values |= {(f"inf_{v}_t${parameters.sign_name(signs)}" if above else f"prior_{v}"): F.col(f"`{column(v, above, signs)}`") for signs in itertools.product((True, False), repeat=len(above))}
        part = net.program(pairs.where(F.col("signature") == s), h, {v: F.col(f"_seen_{v}") for v in net.vertices if v != h}, values, F.col("prior"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = pairs.withColumns({c: F.lit(0.0) for c in ("evidence", "conditional", "posterior")})
    like = matching.mean_likeness([F.when(F.col(f"_seen_{v}").isNotNull(), F.col(f"_seen_{v}").cast("double")) for v in seen])
    return out.select(key, h, *keep, "prior", "evidence", "conditional", "posterior", like.alias("fidelity"), *places)


def resolve(model: Model, index: DataFrame, templates: DataFrame, template_id: str, changes: list[list[Change]] | None = None) -> DataFrame:
    """template_id, matched, accepted, outcome, posterior, trial, issues: one row for each template that is settled.

    A template is settled by an immediate best match or the only acceptable one among candidates without bad evidence; what is not goes
    on with the next trial of ``changes``.
    """
    h = model.hypothesis
    stands = F.col(model.accepted) if model.accepted else F.lit(None).cast(index.schema[h].dataType)
    accepted = resolve_accepted(index.select(h, stands.alias("_stands")), h, "_stands").select(F.col(h).alias("_id"), "accepted")

    def match(t: DataFrame) -> DataFrame:
        scored = cut(score(model, index, t, template_id).where(~matching.bad_evidence(F.col("prior"), F.col("evidence"), F.col("conditional"))))
        one = matching.single(scored, template_id, h).where("matched IS NOT NULL")
        p = scored.select(F.col(template_id).alias("_t"), F.col(h).alias("_m"), "posterior")
        return one.join(p, (F.col(template_id) == F.col("_t")) & (F.col("matched") == F.col("_m"))).join(accepted, F.col("matched") == F.col("_id")).select(template_id, "matched", "accepted", "outcome", "posterior")

    given = templates if "issues" in templates.columns else templates.withColumn("issues", F.array().cast("array<string>"))
    return in_waves(given, template_id, match, changes or [])


def by_identifier(model: Model, index: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Records asked for by id, with their accepted record: probability and likeness are 1; unknown ids are not returned."""
    h = model.hypothesis
    stands = F.col(model.accepted) if model.accepted else F.lit(None).cast(index.schema[h].dataType)
    accepted = resolve_accepted(index.select(h, stands.alias("_stands")), h, "_stands").select(F.col(h).alias("matched"), "accepted")
    return ids.join(accepted, F.col(id_col) == F.col("matched")).withColumns({"posterior": F.lit(1.0), "fidelity": F.lit(1.0), "issues": F.array(F.lit("identifier match"))})
