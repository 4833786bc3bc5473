"""Trees of parent links: numbering, trails, synonyms, common ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credal.operators.lineage import cut, global_rank


def trails(nodes: DataFrame, id_col: str, parent_col: str, max_depth: int = 64) -> DataFrame:
    """id, trail (root first, itself last), depth. Rows that no root reaches (orphans, loops) are not returned.

    One join a level with the frontier of that level, which is checkpointed; the loop ends when a level is empty.
    """
    links = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    level = links.where("parent IS NULL").select("id", F.array("id").alias("trail"))
    found = level
    for _ in range(max_depth):
        level = cut(links.join(level.select(F.col("id").alias("parent"), F.col("trail").alias("above")), "parent").select("id", F.concat("above", F.array("id")).alias("trail")))
        if level.isEmpty():
            return found.withColumn("depth", F.size("trail") - 1)
        found = found.unionByName(level)
    raise ValueError(f"the tree is deeper than {max_depth}")


def numbering(trail: DataFrame, order_width: int = 20) -> DataFrame:
    """Adds left and right: right is the post-order rank, left is right less the descendants, so a subtree is a range.

    Siblings are ordered by id. The order key is the trail with an end mark above every id, so that a node follows its subtree.
    """
    key = F.concat(F.array_join(F.transform("trail", lambda x: F.lpad(x.cast("string"), order_width, "0")), "/"), F.lit("/~"))
    below = trail.select(F.explode("trail").alias("id")).groupBy("id").agg(F.count("*").alias("size"))
    ranked = global_rank(trail.withColumn("_key", key), [F.col("_key")], "right").drop("_key")
    return ranked.join(below, "id").withColumn("left", F.col("right") - F.col("size") + 1).drop("size")


def resolve_accepted(rows: DataFrame, id_col: str, accepted_col: str) -> DataFrame:
    """Adds accepted: the id that an id stands for (itself unless it is a synonym of an id that is there), and missing."""
    known = rows.select(F.col(id_col).alias("_known"))
    out = rows.join(known, F.col(accepted_col) == F.col("_known"), "left")
    return out.withColumn("accepted", F.coalesce("_known", id_col)).withColumn("missing", F.col(accepted_col).isNotNull() & F.col("_known").isNull()).drop("_known")


def common_trail(a: Column, b: Column) -> Column:
    """The longest common prefix of two trails."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(0), n), lambda k: F.when(F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k), k).otherwise(0))
    return F.slice(a, F.lit(1), F.array_max(same))


def nearest_above(trail: Column, wanted: Column) -> Column:
    """The last of a trail's ids that is among the wanted ones."""
    return F.element_at(F.filter(trail, lambda x: F.array_contains(wanted, x)), -1)


def _walk(start: DataFrame, links: DataFrame, keep: Column, max_depth: int) -> DataFrame:
    """record, reached: for each record of ``start`` (record, at) the chain of links (at, next) while ``keep`` holds of the next one."""
    level, found = cut(start), None
    for _ in range(max_depth):
        level = cut(level.join(links, "at").where(keep).select("record", F.col("next").alias("at")))
        if level.isEmpty():
            return found
        step = level.select("record", F.col("at").alias("reached"))
        found = step if found is None else found.unionByName(step)
    raise ValueError(f"a chain is longer than {max_depth}, or a loop")


def broaden(nodes: DataFrame, id_col: str, parent_col: str, name_col: str, keep: Column, up: bool = True, max_depth: int = 64) -> DataFrame:
    """id, names: the sorted distinct names of the ancestors (``up``) or descendants of each record.

    ``keep`` is a condition on a reached record's columns; a record for which it is not true ends the chain, or prunes its subtree.
    Records that reach nothing have an empty array. A parent that is not there ends the chain. A record without a parent ends it as well.
    """
    node = nodes.select(*[F.col(c).alias(f"_{c}") for c in nodes.columns])
    passing = nodes.where(keep).select(F.col(id_col).alias("_ok")).distinct()
    edges = nodes.where(F.col(parent_col).isNotNull()).select(F.col(id_col).alias("child"), F.col(parent_col).alias("parent"))
    links = edges.select(F.col("child").alias("at"), F.col("parent").alias("next")) if up else edges.select(F.col("parent").alias("at"), F.col("child").alias("next"))
    links = links.join(passing, F.col("next") == F.col("_ok"), "left_semi")
    start = nodes.select(F.col(id_col).alias("record"), F.col(id_col).alias("at"))
    reached = _walk(start, links, F.lit(True), max_depth)
    out = nodes.select(F.col(id_col).alias("id"))
    if reached is None:
        return out.withColumn("names", F.array().cast("array<string>"))
    named = reached.join(node.select(F.col(f"_{id_col}").alias("reached"), F.col(f"_{name_col}").alias("name")), "reached")
    grouped = named.groupBy(F.col("record").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return out.join(grouped, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def synonym_names(rows: DataFrame, id_col: str, accepted_col: str, name_col: str, accept: Column | None = None) -> DataFrame:
    """id, names: the sorted distinct names of the records that stand for each record and that ``accept`` (on s_* and a_*) lets through."""
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    s = rows.select(*[F.col(c).alias(f"s_{c}") for c in rows.columns])
    pairs = a.join(s, F.col(f"a_{id_col}") == F.col(f"s_{accepted_col}"))
    pairs = pairs.where(accept) if accept is not None else pairs
    names = pairs.groupBy(F.col(f"a_{id_col}").alias("id")).agg(F.array_sort(F.collect_set(f"s_{name_col}")).alias("names"))
    return rows.select(F.col(id_col).alias("id")).join(names, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def copy_from_accepted(rows: DataFrame, id_col: str, accepted_col: str, columns: list[str]) -> DataFrame:
    """Rows with each of ``columns`` filled, where null, from the accepted record; rows whose accepted record is missing stay as they are."""
    source = rows.select(F.col(id_col).alias("_from"), *[F.col(c).alias(f"_from_{c}") for c in columns])
    out = rows.join(source, F.col(accepted_col) == F.col("_from"), "left")
    return out.withColumns({c: F.coalesce(c, f"_from_{c}") for c in columns}).select(*rows.columns)


def copy_from_above(nodes: DataFrame, id_col: str, parent_col: str, select: Column, sources: dict[str, str], include_self: bool = True) -> DataFrame:
    """id, and per target the source column's value of the nearest record on the trail for which ``select`` holds (itself first).

    One equi-join of the trails' entries with the selected records; the nearest is the deepest, found by a map-side maximum.
    """
    path = trails(nodes, id_col, parent_col)
    entries = path.select("id", F.posexplode("trail").alias("place", "above")).where(F.lit(include_self) | (F.col("above") != F.col("id")))
    chosen = nodes.where(select).select(F.col(id_col).alias("above"), F.struct(*[F.col(s).alias(t) for t, s in sources.items()]).alias("value"))
    nearest = entries.join(chosen, "above").groupBy("id").agg(F.max_by("value", "place").alias("value"))
    return path.select("id").join(nearest, "id", "left").select("id", *[F.col(f"value.{t}").alias(t) for t in sources])
