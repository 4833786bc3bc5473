"""Matching by waves: what one trial leaves open goes to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credal.operators.conditions import Change
from credal.operators.lineage import cut


def trials_of(changes: list[list[Change]]) -> list[list[Change]]:
    """Each combination of one change or none from each list; no change first, the last list varying fastest."""
    out: list[list[Change]] = [[]]
    for options in changes:
        out = [t + c for t in out for c in [[], *[[o] for o in options]]]
    return out


def in_waves(templates: DataFrame, id_col: str, match: Callable[[DataFrame], DataFrame], changes: list[list[Change]]) -> DataFrame:
    """match's columns, trial (number) and issues of the first trial that settles each template; templates that none settles are not returned.

    templates have an array column ``issues``. ``match`` gives at most one row a template, with id_col and without issues. Each wave
    works on the templates still open, less those that its changes leave as they are, and is checkpointed; the number of waves is
    that of the trials, not of the templates.
    """
    open_, found = templates, None
    for number, steps in enumerate(trials_of(changes)):
        tried = open_
        if steps:
            guard = F.lit(False)
            for s in steps:
                guard = guard | F.coalesce(s.guard, F.lit(False))
            tried = tried.where(guard)
            for s in steps:
                tried = s.apply(tried)
        settled = match(tried).join(tried.select(F.col(id_col).alias("_id"), "issues"), F.col(id_col) == F.col("_id")).drop("_id").withColumn("trial", F.lit(number))
        settled = cut(settled)
        found = settled if found is None else found.unionByName(settled)
        gone = settled.select(F.col(id_col).alias("_id"))
        open_ = cut(open_.join(gone, F.col(id_col) == F.col("_id"), "left_anti"))
        if open_.isEmpty():
            break
    return found


def hinted(templates: DataFrame, id_col: str, hints: dict[str, str]) -> DataFrame:
    """One row for each choice of hints (column: an array column of values to try), no hint first; trial numbers them as waves do."""
    out = templates.withColumn("trial", F.lit(0).cast("long"))
    for column, values in hints.items():
        options = F.concat(F.array(F.col(column)), F.coalesce(F.col(values), F.array().cast(templates.schema[values].dataType)))
        out = out.select("*", F.size(options).alias("_n"), F.posexplode(options).alias("_k", "_v")).withColumns({"trial": F.col("trial") * F.col("_n") + F.col("_k"), column: F.col("_v")}).drop("_n", "_k", "_v")
    return out
