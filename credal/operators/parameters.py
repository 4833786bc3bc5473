"""Priors and conditional probabilities as weighted aggregates."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed value: the least probability; one less than it is the greatest.
LEAST = 1e-9


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(1.0 - LEAST), c))


def priors(rows: DataFrame, value: str, weight: str, default: float = 1.0) -> DataFrame:
    """value, weight, prior: each value's share of the total weight; 0 where the total is not positive."""
    per = rows.groupBy(value).agg(F.sum(F.coalesce(weight, F.lit(default))).alias("weight"))
    total = rows.agg(F.sum(F.coalesce(weight, F.lit(default))).alias("total"))
    return per.crossJoin(F.broadcast(total)).select(value, "weight", F.when(F.col("total") > 0, clamp(F.col("weight") / F.col("total"))).otherwise(0.0).alias("prior"))


def conditionals(rows: DataFrame, outcome: str, inputs: list[str], weight: str, default: float = 1.0) -> DataFrame:
    """outcome, inputs, p_t (outcome given all inputs) and p_f (outcome given none of them), from one pass of sums."""
    w = F.coalesce(weight, F.lit(default))
    both = rows.groupBy(outcome, *inputs).agg(F.sum(w).alias("both"))
    given = rows.groupBy(*inputs).agg(F.sum(w).alias("given"))
    alone = rows.groupBy(outcome).agg(F.sum(w).alias("alone"))
    total = rows.agg(F.sum(w).alias("total"))
    joined = both.join(given, inputs).join(alone, outcome).crossJoin(F.broadcast(total))
    share = lambda a, b: F.when(b > 0, clamp(a / b)).otherwise(0.0)
    c = F.col
    return joined.select(outcome, *inputs, share(c("both"), c("given")).alias("p_t"), share(c("alone") - c("both"), c("total") - c("given")).alias("p_f"))


def posterior(prior: Column, p_t: Column, p_f: Column, seen: Column) -> dict[str, Column]:
    """evidence, conditional, posterior, boost of a hypothesis for one observation (true, false, or null: both)."""
    given_t = F.when(seen.isNull(), 1.0).when(seen, p_t).otherwise(1 - p_t)
    given_f = F.when(seen.isNull(), 1.0).when(seen, p_f).otherwise(1 - p_f)
    evidence = given_t * prior + given_f * (1 - prior)
    return {"evidence": evidence, "conditional": given_t, "posterior": F.when(evidence < 1e-9, 0.0).otherwise(given_t * prior / evidence), "boost": F.when(evidence > 1e-9, given_t / evidence).otherwise(0.0)}


def any_of(boosts: Column) -> Column:
    """The probability that at least one of independent findings holds."""
    return 1 - F.aggregate(boosts, F.lit(1.0), lambda acc, x: acc * (1 - x))


def signed_weights(rows: DataFrame, outcome: str, inputs: list[str], weight: str, default: float = 1.0) -> DataFrame:
    """outcome, inputs and, for every sign pattern of the inputs (t: the row's value, f: not it), g_<signs>, the weight of the pattern, and
    b_<signs>, the weight of the pattern with the outcome.

    One row for each distinct combination with an outcome. "Not a value" holds of null as well. A null input is left out of the
    evidence. All signed sums are inclusion-exclusion over positive marginals, and those come from one pre-aggregated table: each
    combination looks up one marginal for each subset of the columns, so no combination meets another.
    """
    w = F.coalesce(F.col(weight), F.lit(default))
    columns = [outcome, *inputs]
    names = [f"c{k}" for k in range(len(columns))]
    base = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(columns, names)]).agg(F.sum(w).alias("w"))
    masks = range(2 ** len(names))
    key = lambda mask: F.struct(*[(F.col(n) if mask >> k & 1 else F.lit(None).cast(base.schema[n].dataType)).alias(n) for k, n in enumerate(names)])
    each = lambda pairs: F.explode(F.array(*[F.struct(F.lit(m).alias("want"), e.alias("mask"), F.to_json(k).alias("key")) for m, e, k in pairs]))
    there = lambda mask: sum((F.when(F.col(n).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, n in enumerate(names) if mask >> k & 1), F.lit(0))
    sums = base.select("w", each([(m, F.lit(m), key(m)) for m in masks]).alias("e")).groupBy("e.mask", "e.key").agg(F.sum("w").alias("sum"))
    wanted = base.where("c0 IS NOT NULL").select(*names, each([(m, there(m), key(m)) for m in masks]).alias("e")).select(*names, "e.want", "e.mask", "e.key")
    found = wanted.join(sums, ["mask", "key"]).withColumn("id", F.to_json(F.struct(*names)))
    table = found.groupBy("id").agg(*[F.first(n).alias(n) for n in names], *[F.max(F.when(F.col("want") == m, F.col("sum"))).alias(f"w{m}") for m in masks])

    def signed(with_outcome: bool, signs: tuple[bool, ...]) -> Column:
        yes = sum(1 << (k + 1) for k, s in enumerate(signs) if s) + (1 if with_outcome else 0)
        no = [k for k, s in enumerate(signs) if not s]
        total = F.lit(0.0)
        for size in range(len(no) + 1):
            for taken in itertools.combinations(no, size):
                blank = F.lit(False)
                for k in taken:
                    blank = blank | F.col(names[k + 1]).isNull()
                total = total + F.when(blank, 0.0).otherwise((-1.0) ** size * F.col(f"w{yes + sum(1 << (k + 1) for k in taken)}"))
        return total

    both = [(prefix, signs) for prefix in "gb" for signs in itertools.product((True, False), repeat=len(inputs))]
    return table.select(*[F.col(n).alias(c) for n, c in zip(names, columns)], *[signed(p == "b", s).alias(f"{p}_{sign_name(s)}") for p, s in both])


def sign_name(signs: tuple[bool, ...]) -> str:
    return "".join("t" if s else "f" for s in signs)


def signed_conditionals(rows: DataFrame, outcome: str, inputs: list[str], weight: str, default: float = 1.0) -> DataFrame:
    """outcome, inputs and p_<signs> for every sign pattern of the inputs: the pattern's weight with the outcome over its weight.

    As ``signed_weights``, but where all inputs are null the probability is 1 for the all-true pattern and 0 for others. Probabilities
    are clamped; a weight of nothing gives the least.
    """
    table = signed_weights(rows, outcome, inputs, weight, default)
    blank = F.coalesce(*[F.col(n).cast("string") for n in inputs], F.lit(None).cast("string")).isNull() if inputs else F.lit(False)
    out = []
    for signs in itertools.product((True, False), repeat=len(inputs)):
        n = sign_name(signs)
        out.append(F.when(blank, 1.0 if all(signs) else 0.0).otherwise(own_conditional(F.lit(0.0), F.col(f"b_{n}"), F.col(f"g_{n}"))).alias(f"p_{n}"))
    return table.select(outcome, *inputs, *out)


def own_conditional(own: Column, with_outcome: Column, given: Column) -> Column:
    """The clamped probability of an outcome among all records but the one supposed: its own weight is taken from both sums."""
    return F.when(given - own < LEAST, LEAST).otherwise(clamp((with_outcome - own) / (given - own)))
