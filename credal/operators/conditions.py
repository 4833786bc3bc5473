"""Conditions and observations as boolean columns, and modifications of templates that they guard."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equals(value: Column, constant) -> Column:
    """Equal to a constant, texts in any case; a null constant asks for null. Never null."""
    if constant is None:
        return value.isNull()
    same = F.lower(value) == constant.lower() if isinstance(constant, str) else value == F.lit(constant)
    return F.coalesce(same, F.lit(False))


def present(columns: Iterable[str], every: bool = False) -> Column:
    return reduce(lambda a, b: a & b if every else a | b, [F.col(c).isNotNull() for c in columns])


def combined(conditions: list[Column], every: bool = True) -> Column | None:
    """All or any of the conditions; none at all is no condition."""
    return reduce(lambda a, b: a & b if every else a | b, conditions) if conditions else None


def observed(column: str, value=None, sign: bool = True, style: str = "phrase") -> Column:
    """Records that an observation fits. No value asks for presence (with a negative sign, absence).

    value: a constant, several (any of them), or a pair of bounds with style ``range``; style ``wildcard`` takes * and ?. Negative
    observations hold of null as well.
    """
    c = F.col(column)
    if value is None:
        return c.isNotNull() if sign else c.isNull()
    if style == "range":
        fits = c.between(*value)
    elif style == "wildcard":
        import re

        fits = F.lower(c).rlike("^" + re.escape(str(value).lower()).replace(r"\*", ".*").replace(r"\?", ".") + "$")
    elif isinstance(value, (list, tuple, set)):
        fits = reduce(lambda a, b: a | b, [equals(c, v) for v in value])
    else:
        fits = equals(c, value)
    fits = F.coalesce(fits, F.lit(False))
    return fits if sign else ~fits


def searched(df: DataFrame, required: list[Column], optional: list[tuple[Column, float]], cutoff: float = 0.0) -> DataFrame:
    """Records that fit all required observations, with score: the weights of the optional ones that fit; those under the cutoff go."""
    found = df.where(combined(required)) if required else df
    score = sum((F.when(c, F.lit(w)).otherwise(0.0) for c, w in optional), F.lit(0.0))
    return found.withColumn("score", score).where(F.col("score") >= cutoff)


def observations(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """id, field, value: one row for each value that a template gives."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(id_col).alias("id"), F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select("id", "p.*")


def presence_kept(signature: Column, place: int, given: Column, own_name: Column) -> Column:
    """Candidates of a group that must be there: where a template gives a value other than its own name, the signature's place is T."""
    asked = given.isNotNull() & ~F.coalesce(F.lower(given) == F.lower(own_name), F.lit(False))
    return ~asked | (F.substring(signature, place + 1, 1) == "T")


def start_kept(given: Column, variants: Column, length: int = 4) -> Column:
    """Candidates any of whose names begins as the given one, over its first ``length`` characters; a template without one keeps all."""
    head = F.lower(F.left(given, F.lit(length)))
    return given.isNull() | F.coalesce(F.exists(variants, lambda v: F.startswith(F.lower(v), head)), F.lit(False))


def in_scope(locations: Column, scope: Column) -> Column:
    """A template's places if one of them is in scope, else null."""
    return F.when(F.coalesce(F.arrays_overlap(locations, scope), F.lit(False)), locations)


@dataclass(frozen=True)
class Change:
    """A modification: new values by column (in order, each sees the ones before), a guard, columns that are derived and cleared first, issues."""

    name: str
    sets: tuple[tuple[str, Column], ...]
    guard: Column
    clears: tuple[str, ...] = ()
    issues: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        """The template with the change where its guard held before; issues join the array column ``issues``."""
        out = df.withColumn("_go", F.coalesce(self.guard, F.lit(False)))
        go = F.col("_go")
        for c in self.clears:
            out = out.withColumn(c, F.when(~go, F.col(c)))
        for c, value in self.sets:
            out = out.withColumn(c, F.when(go, value).otherwise(F.col(c)))
        if self.issues:
            out = out.withColumn("issues", F.when(go, F.array_union("issues", F.array(*map(F.lit, self.issues)))).otherwise(F.col("issues")))
        return out.drop("_go")


def _issues(issue: str | None) -> tuple[str, ...]:
    return (issue,) if issue else ()


def remove(name: str, columns: list[str], clears: tuple[str, ...] = (), issue: str | None = None, where: Column | None = None) -> Change:
    """Nulls columns, where any of them has a value."""
    guard = present(columns) if where is None else present(columns) & where
    return Change(name, tuple((c, F.lit(None)) for c in columns), guard, clears, _issues(issue))


def assign(name: str, column: str, value, issue: str | None = None, where: Column | None = None) -> Change:
    """Sets a constant (or null)."""
    return Change(name, ((column, F.lit(value)),), F.lit(True) if where is None else where, (), _issues(issue))


def choose(name: str, target: str, columns: list[str], issue: str | None = None) -> Change:
    """Sets the first value there is."""
    return Change(name, ((target, F.coalesce(*columns)),), present(columns), (), _issues(issue))


def join(name: str, target: str, columns: list[str], issue: str | None = None) -> Change:
    """Sets the values joined with a space, where all are there."""
    return Change(name, ((target, F.concat_ws(" ", *columns)),), present(columns, every=True), (), _issues(issue))


def suffix(name: str, column: str, text: str, downstream: tuple[str, ...] = (), issue: str | None = None) -> Change:
    """Adds an ending where the value does not end with it (any case); downstream columns with the same value follow it."""
    new = F.concat(F.col(column), F.lit(text))
    ending = F.endswith(F.lower(F.col(column)), F.lit(text.lower()))
    follow = tuple((d, F.when(F.col(d) == F.col(column), F.concat(F.col(d), F.lit(text))).otherwise(F.col(d))) for d in downstream)
    return Change(name, (*follow, (column, new)), F.col(column).isNotNull() & ~ending, (), _issues(issue))


def composite(name: str, parts: list[Change], issue: str | None = None) -> Change:
    """All changes one after the other, where the guards of all hold of the template as it was; derived columns are cleared first."""
    sets = tuple(x for p in parts for x in p.sets)
    return Change(name, sets, combined([p.guard for p in parts]), tuple(dict.fromkeys(c for p in parts for c in p.clears)), tuple(i for p in parts for i in p.issues) + _issues(issue))
