"""From sources to an index: records of all sources, ids and marks, derived values, the tree with its synonyms, sets of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credal.operators.hierarchy import trails
from credal.plans.network import Network


def loaded(sources: list[DataFrame]) -> DataFrame:
    """The rows of all sources, repeated ones too; columns that a source lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def generated_id(*keys: Column) -> Column:
    """An id in the form of a UUID (version 8) that is the same for the same keys, run after run."""
    h = F.sha2(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])), 256)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(13, 3)), F.concat(F.lit("a"), part(16, 3)), part(19, 12))


def filled(own: Column, other: Column, overwrite: bool = False) -> Column:
    """A value carried over from a record to a template or back: in place of the own one, or only where there is none."""
    return F.coalesce(other, own) if overwrite else F.coalesce(own, other)


def derived(df: DataFrame, steps: dict[str, tuple[list[str], Column]]) -> DataFrame:
    """Values that are missing, from what they need: column: (columns needed, expression). Each step sees those that it needs; a loop is an error."""
    needs = {name: list(above) for name, (above, _) in steps.items()}
    order = Network("derivations", list(steps), []).derivation_order(needs)
    for name in order:
        have = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(have, steps[name][1]))
    return df


def annotated(df: DataFrame, id_col: str, order: Column, parent: str | None = None, accepted: str | None = None, concept: Column | None = None) -> DataFrame:
    """Adds annotations: identifierCreated for a null id or one that an earlier row has (a generated one takes its place), and, for concepts, isRoot
    (neither parent nor accepted record) and isSynonym (no parent, an accepted record).

    ``order`` must be distinct over all rows; the first row of an id by it keeps the id. Firsts are found by a map-side minimum, so a frequent id
    is no sort in one task. Blank texts count as null.
    """
    blank = lambda c: F.lit(True) if c is None else F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    rows = df.withColumn("_order", order)
    firsts = rows.where(~blank(id_col)).groupBy(F.col(id_col).alias("_first_id")).agg(F.min("_order").alias("_first"))
    joined = rows.join(firsts, F.col(id_col) == F.col("_first_id"), "left")
    fresh = ~F.coalesce(F.col("_order") == F.col("_first"), F.lit(False))
    is_concept = F.lit(True) if concept is None else F.coalesce(concept, F.lit(False))
    marks = [F.when(fresh, "identifierCreated"), F.when(is_concept & blank(parent) & blank(accepted), "isRoot"), F.when(is_concept & blank(parent) & ~blank(accepted), "isSynonym")]
    out = joined.withColumn("annotations", F.filter(F.array(*marks), lambda x: x.isNotNull()))
    return out.withColumn(id_col, F.when(fresh, generated_id(F.col("_order"))).otherwise(F.col(id_col).cast("string"))).drop("_order", "_first", "_first_id")


def has_mark(annotations: Column, mark: str) -> Column:
    return F.coalesce(F.array_contains(annotations, F.lit(mark)), F.lit(False))


def expanded(df: DataFrame, id_col: str, parent: str, accepted: str) -> DataFrame:
    """The records that the tree's roots reach, and the synonyms (no parent, an accepted record). Others (orphans) are left out: ``orphans``."""
    return _reached(df, id_col, parent, accepted, "left_semi")


def orphans(df: DataFrame, id_col: str, parent: str, accepted: str) -> DataFrame:
    return _reached(df, id_col, parent, accepted, "left_anti")


def _reached(df: DataFrame, id_col: str, parent: str, accepted: str, how: str) -> DataFrame:
    synonym = F.col(parent).isNull() & F.col(accepted).isNotNull()
    reached = trails(df.where(~synonym), id_col, parent).select(F.col("id").alias("_reached"))
    tree = df.where(~synonym).join(reached, F.col(id_col) == F.col("_reached"), how)
    return tree.unionByName(df.where(synonym)) if how == "left_semi" else tree


def alternates(names: Column, others: Column) -> Column:
    """The further names that are not among the first ones, each once, in order."""
    return F.array_except(F.coalesce(others, F.array().cast("array<string>")), F.coalesce(names, F.array().cast("array<string>")))


def identifiers(trail: Column, accepted: Column) -> Column:
    """All ids by which a match may be asked for: its trail, then the accepted record's; each once."""
    own = F.when(accepted.isNotNull(), F.array(accepted))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(trail.cast("array<string>"), none), F.coalesce(own.cast("array<string>"), none)))


def common_names(names: DataFrame, taxon: str, name: str, weight: str) -> DataFrame:
    """taxon, names: each taxon's names, by weight, greatest first, then by name; a name counts once, by its greatest weight. Null names are none."""
    each = names.where(F.col(name).isNotNull()).groupBy(taxon, name).agg(F.max(weight).alias("_w"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_w")).alias("w"), F.col(name).alias("name"))))
    return each.groupBy(taxon).agg(F.transform(ordered, lambda x: x["name"]).alias("names"))


def suggested_records(suggestions: DataFrame, record: str, index: DataFrame, id_col: str, accepted: str, synonyms: bool = True) -> DataFrame:
    """Suggestions with stands_for, the accepted record's id (the record's own where it is accepted); without synonyms only those of accepted records."""
    known = index.select(F.col(id_col).alias("_id"), F.coalesce(F.col(accepted), F.col(id_col)).alias("stands_for"))
    out = suggestions.join(known, F.col(record) == F.col("_id")).drop("_id")
    return out if synonyms else out.where(F.col(record) == F.col("stands_for"))
