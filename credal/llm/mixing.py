"""Mixing sources to target weights by temperature.

With p the sources' shares of all tokens, weights are p ** alpha, normalised. alpha is found by bisection between 1 (as they
are) and 0 (all sources alike): the smallest alpha whose weights have at most ``target_entropy`` (a fraction of the largest
possible one) and ask no source for more than ``max_epochs`` passes at the budget. Where the shares as they are have more entropy,
alpha goes beyond 1 (large sources gain) until the target is met or the passes forbid it; ``met`` and a warning say if it is not. The budget is in tokens; by default it is the
smallest one that lets no source fall short of one pass, so nothing is left out and small sources are repeated.

A source's tokens are realised as block permutations: in each pass its documents are dealt by a seeded hash into blocks of
about ``block_tokens`` tokens (larger ones where a source would have more than its part of ``PLAN`` blocks), blocks and the
documents in them are ordered by hash, and the pass is cut where the source's budget ends. Only the block that the budget
ends in is cut inside. ``slot`` in [0, 1) is an occurrence's place in the mixed stream: the tokens of its source before it,
to the block exactly and inside a block by hash, over the source's quota. Sorting by it interleaves the sources by weight.

Sources, tokens and budgets are sums by source (at most ``SOURCES`` sources, else an error), sums of blocks at most ``PLAN`` a
pass: this alone is collected or broadcast. The cut of a source's last pass is one place in its order, found on ids and
counts: first by block, then inside one block. Texts are only filtered by it, in place, so a hot source is as parallel as
any. Null source: a source of its own. Null or empty text has 0 words, and a document without tokens is kept once. Repeated
rows are documents of their own but go to the same places. Further columns are kept, whatever their names; one named like a
column that is added gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import materialise

#: The columns that ``mix`` adds; the most sources; the most blocks of a pass, over all sources.
ADDED = ("mix_tokens", "mix_weight", "mix_epoch", "mix_block", "slot")
SOURCES, PLAN = 1 << 16, 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    alpha: float
    budget: float
    weights: dict[str | None, float]
    quota: dict[str | None, float]
    epochs: dict[str | None, float]
    met: bool = True


def weights_at(tokens: dict, alpha: float) -> dict:
    most = max(tokens.values())
    raw = {s: (t / most) ** alpha if t else 0.0 for s, t in tokens.items()}
    return {s: w / sum(raw.values()) for s, w in raw.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def choose(tokens: dict, budget: float | None = None, target_entropy: float = 1.0, max_epochs: float = 2.0) -> Mix:
    """The mix for token counts by source (in a fixed order)."""
    full = {s: t for s, t in tokens.items() if t}
    if not full:
        return Mix(1.0, 0.0, {s: 0.0 for s in tokens}, {s: 0.0 for s in tokens}, {s: 0.0 for s in tokens})
    limit = target_entropy * math.log(len(full)) if len(full) > 1 else 0.0

    def at(alpha: float) -> tuple[dict, float]:
        w = weights_at(full, alpha)
        return w, budget if budget is not None else max(full[s] / w[s] if w[s] else math.inf for s in full)

    def even(alpha: float) -> bool:
        return entropy(at(alpha)[0]) > limit + 1e-12

    def allowed(alpha: float, slack: float = 0.0) -> bool:
        w, b = at(alpha)
        return b < math.inf and max(b * w[s] / full[s] for s in full) <= max_epochs + slack

    def fits(alpha: float) -> bool:
        return not even(alpha) and allowed(alpha, 1e-9)

    lo, hi = 0.0, 1.0
    if fits(0.0):
        hi = 0.0
    else:
        for _ in range(60):  # alpha = 1 is kept even where the budget alone asks for more passes
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    if even(1.0) and allowed(1.0) and len(set(full.values())) > 1:
        lo, hi = 1.0, 2.0
        while even(hi) and allowed(hi):
            lo, hi = hi, 2 * hi
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if even(mid) and allowed(mid) else (lo, mid)
        hi = hi if allowed(hi) else lo
    w, b = at(hi)
    met = not even(hi)
    if not met:
        warnings.warn(f"mixing: entropy {entropy(w) / math.log(len(full)):.4f} of the largest at alpha {hi:.4f}, above the target of {target_entropy}", stacklevel=2)
    quota = {s: b * w.get(s, 0.0) for s in tokens}
    return Mix(hi, b, {s: w.get(s, 0.0) for s in tokens}, quota, {s: quota[s] / full[s] if s in full else 0.0 for s in tokens}, met)


def mix(docs: DataFrame, budget: float | None = None, target_entropy: float = 1.0, max_epochs: float = 2.0, seed: int = 11,
        block_tokens: int = 1 << 18, tokens: Column | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The columns of docs for every occurrence, and mix_tokens, mix_weight, mix_epoch (from 0), mix_block, slot.

    tokens: a document's token count; the words of its column ``text`` by default. A pass takes whole documents: the one in which the
    source's budget ends is the last.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c not in ADDED]
    source, ident = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    count = F.coalesce((tokens if tokens is not None else word_count(F.col("text"))).cast("long"), F.lit(0))
    # Ids and counts alone: all sums and cuts are found on these.
    slim = materialise(docs.select(source.alias("s"), ident.alias("id"), count.alias("n")), "mix")
    totals = {r["s"]: r["t"] or 0 for r in slim.groupBy("s").agg(F.sum("n").alias("t")).limit(SOURCES + 1).collect()}
    if len(totals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    chosen = choose({s: totals[s] for s in sorted(totals, key=lambda s: (s is not None, s or ""))}, budget, target_entropy, max_epochs)
    passes = {s: max(1, math.ceil(chosen.epochs[s] - 1e-9)) for s in totals}
    most = max(1, PLAN // max(1, len(totals)))
    # The source, its weight, tokens, quota, passes and blocks, and what its last pass may take; nothing where that is all of it.
    rows = [(s, chosen.weights[s], float(t), max(chosen.quota[s], 1.0), passes[s], min(most, math.ceil(t / block_tokens) or 1), chosen.quota[s] - (passes[s] - 1) * t if chosen.quota[s] < passes[s] * t - 0.5 else None) for s, t in totals.items()]
    table = spark.createDataFrame(rows, "ts string, weight double, total double, quota double, passes int, blocks long, room double")

    def dealt(df: DataFrame) -> DataFrame:
        """With h, block and bh, the order of documents and blocks in the pass."""
        df = df.withColumn("h", F.xxhash64(F.lit(seed), "s", "pass", "id")).withColumn("block", F.pmod("h", F.col("blocks")))
        return df.withColumn("bh", F.xxhash64(F.lit(seed + 1), "s", "pass", "block"))

    every = dealt(slim.join(F.broadcast(table), F.col("s").eqNullSafe(F.col("ts"))).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))))
    before = lambda part, order: F.coalesce(F.sum("sum").over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = every.groupBy("s", "pass", "bh", "block").agg(F.sum("n").alias("sum"), F.first("blocks").alias("blocks"), F.first(F.when(F.col("pass") == F.col("passes") - 1, F.col("room"))).alias("room"))
    sums = materialise(sums.withColumn("before", before(["s", "pass"], ["bh", "block"])), "mixblocks")
    edge = sums.where("before < room AND before + sum >= room").select(F.col("s").alias("es"), F.col("pass").alias("ep"), F.col("block").alias("eb"), (F.col("room") - F.col("before")).alias("left"))
    inside = every.where("n > 0").join(F.broadcast(edge), F.col("s").eqNullSafe(F.col("es")) & (F.col("pass") == F.col("ep")) & (F.col("block") == F.col("eb")))
    inside = inside.groupBy("s", "bh", "block", "h", "id").agg(F.sum("n").alias("sum"), F.first("left").alias("left")).withColumn("before", before(["s"], ["h", "id"]))
    cuts = inside.where("before < left").groupBy("s").agg(F.max(F.struct("bh", "block", "h", "id")).alias("cut"))
    # One row a source, with its blocks' sums by pass and block: at most PLAN of them a pass.
    places = F.struct((F.col("pass") * F.col("blocks") + F.col("block")).alias("at"), F.col("before").cast("double").alias("before"), F.col("sum").cast("double").alias("sum"))
    dense = table.select("ts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") * F.col("blocks") - 1)).alias("k")).join(sums.select("s", places.alias("p")), F.col("ts").eqNullSafe(F.col("s")) & (F.col("k") == F.col("p.at")), "left")
    arrays = dense.groupBy("ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p.before", "p.sum"))), lambda x: F.struct(x["before"].alias("before"), x["sum"].alias("sum"))).alias("places"))
    plan = table.join(cuts, F.col("ts").eqNullSafe(F.col("s")), "left").drop("s")
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    out = docs.select(row, source.alias("s"), ident.alias("id"), count.alias("n")).join(F.broadcast(plan), F.col("s").eqNullSafe(F.col("ts"))).drop("ts")
    out = dealt(out.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))))
    last = F.col("cut").isNotNull() & (F.col("pass") == F.col("passes") - 1)
    kept = F.when(F.col("n") == 0, F.col("pass") == 0).otherwise(~last | (F.struct("bh", "block", "h", "id") <= F.col("cut")))
    out = out.where(kept).join(F.broadcast(arrays), F.col("s").eqNullSafe(F.col("ts")))
    place = F.expr("places[int(pass * blocks + block)]")
    share = (F.shiftright("h", 34) + (1 << 29)) / float(1 << 30)
    whole = F.when(F.col("room").isNull(), F.col("passes") * F.col("total")).otherwise(F.col("quota"))
    done = F.when(F.col("total") > 0, (F.col("pass") * F.col("total") + place["before"] + place["sum"] * share) / whole).otherwise(share)
    return out.select(*[F.col(f"row.`{c}`") for c in names], F.col("n").alias("mix_tokens"), F.col("weight").alias("mix_weight"), F.col("pass").alias("mix_epoch"), F.col("block").alias("mix_block"), F.least(done, F.lit(1 - 2.0**-40)).alias("slot"))
