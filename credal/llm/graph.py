"""Connected components of link tables, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import give_back
from .runtime import materialise, release, tidy

#: So many links (16 bytes each) are one task's work; rounds over more of them cost their shuffles, whatever the number of links.
WHOLE = 1 << 20


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 to n - 1 that links (a, b) lead to from each: larger roots are hung on smaller ones until none differ."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component from all links (u, v)."""
    links = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if links:
        u, v = (np.concatenate(x) for x in zip(*links))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        found = ids[smallest(at[: len(u)], at[len(u) :], len(ids))]
        for lo in range(0, len(ids), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + (1 << 17)]), pa.array(found[lo : lo + (1 << 17)])], ["id", "component"])
    give_back()


@tidy("components")
def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(id, component) for every id in the links (a, b), long values: component is the smallest id that links lead to.

    Up to WHOLE links are answered by one task. More go through rounds of alternating stars: every id's larger neighbours, then its
    smaller ones, are hung on the smallest id around. Groups are never gathered there: a round is joins with minimums, and a hot id's links are pre-aggregated and joined under
    skew handling. A link with a null end or to itself counts for nothing (an id linked only with itself is left out).
    """

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    given = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), tag)
    if given.count() <= WHOLE:
        return given.coalesce(1).mapInArrow(_at_once, "id long, component long")
    given, every = materialise(given.distinct(), tag), given
    release(every)
    # An id's links to smaller ones become one link to the smallest, which takes the others over: several leaders of one group meet at once.
    lowest = given.groupBy("u").agg(F.min("v").alias("m"))
    taken = given.join(lowest.withColumnRenamed("u", "id"), F.col("u") == F.col("id")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    now = materialise(lowest.select("u", F.col("m").alias("v")).union(taken.distinct()).distinct(), tag)
    release(given)
    seen = print_of(now)
    while True:
        # Large star: with m(u) = the smallest of u and its neighbours, each larger neighbour hangs on m(u).
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each smaller neighbour, and the id itself, hangs on the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialise(small, tag)
        release(now)
        now, before, seen = new, seen, print_of(new)
        if before == seen:  # the number of links and two hashes over all of them
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
