"""Each row beside the next one in descending id order, with one shuffle of the texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import columns_named, materialise
from .spotsigs import ANCHORS, fingerprint, fingerprint_texts, likeness, link


def _bucket(bounds: list[int], column: str) -> str:
    """SQL for the number of bounds at or under the id, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {column} < {bounds[mid]}L THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    return f"CASE WHEN {column} IS NULL THEN 0 ELSE {tree(0, len(bounds))} END"


def descending(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """doc_id, text, bucket, tail, component, dealt by range of ids, each partition sorted by descending id (equal ids by text).

    groups (doc_id, component_id, one row an id): an id's rows are led by one with a null text and its component; the others have none.

    Each bucket ends with a tail row: the document that follows its last one in the whole order (the first document after
    the last). The driver sees the bounds and one id a bucket, never more.
    """
    rows = columns_named(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id")
    found = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100 * n).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    bucket = F.expr(_bucket(bounds, "doc_id"))
    first = {r["bucket"]: r["doc_id"] for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("doc_id")).collect()}
    order = sorted(first, reverse=True)
    tails: dict[int | None, list[int]] = {}
    for k, b in enumerate(order):
        tails.setdefault(first[order[(k + 1) % len(order)]], []).append(b)
    small = docs.sparkSession.createDataFrame([(k, v) for k, v in tails.items()], "tail_id long, tails array<int>")
    both = rows.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("tail_id")), "left")
    own = F.array(F.struct(bucket.cast("int").alias("bucket"), F.lit(0).alias("tail")))
    extra = F.transform(F.coalesce("tails", F.array().cast("array<int>")), lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("tail")))
    none = F.lit(None).cast("long").alias("component")
    dealt = both.select("doc_id", "text", F.explode(F.concat(own, extra)).alias("to")).select("doc_id", "text", "to.bucket", "to.tail", none)
    if groups is not None:  # in the same shuffle, so texts are not moved again
        dealt = dealt.union(groups.where("doc_id IS NOT NULL").select("doc_id", F.lit(None).cast("string"), bucket.cast("int"), F.lit(0), "component_id"))
    return dealt.repartitionById(max(1, len(bounds) + 1), F.col("bucket")).sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))


def edited_fingerprints(docs: DataFrame, chain: int = 2, anchors: str = ANCHORS, id_col: str = "doc_id", text_col: str = "text", percent: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the beginning of the next document's.

    The last floor(n / 3) code points are replaced by the first as many (or all) of the next document by descending id. percent: with
    component_id, the smallest id that links of that likeness lead to (``spotsigs.link``: all documents, by length partitions).

    Null text is empty; equal ids follow one another by text and share a component, a null id comes last and has none; a single document is
    its own next one. Further columns of any name are ignored. An empty table gives an empty result.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] + ["component_id"] * (percent is not None)
    groups = None
    if percent is not None:
        groups = link(docs, percent, chain, anchors, id_col, text_col).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        groups = materialise(groups, "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, which waits for its next one
        of: tuple = (None, None)  # an id and its component
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = fingerprint_texts(batch.column("text"), chain, anchors)
            rows = [] if held is None else [held]
            for doc, text, bucket, tail, component, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail", "component")), sets):
                if text is None:
                    of = (doc, component)
                else:
                    rows.append((doc, text, bucket, tail, own, of[1] if doc == of[0] else None))
            held = rows[-1] if rows else None
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3] and a[2] == b[2]]
            for lo in range(0, len(pairs), 2000):
                some = pairs[lo : lo + 2000]
                edited = [a[1][: len(a[1]) - len(a[1]) // 3] + b[1][: len(a[1]) // 3] for a, b in some]
                changed = fingerprint_texts(pa.array(edited, pa.large_string()), chain, anchors)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in some], pa.int64()),
                        pa.array([len(a[1]) for a, _ in some], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                        pa.array([fingerprint(a[4]) for a, _ in some]),
                        pa.array([fingerprint(c) for c in changed]),
                        pa.array([likeness(a[4], c) for (a, _), c in zip(some, changed)], pa.float64()),
                        pa.array([likeness(a[4], b[4]) for a, b in some], pa.float64()),
                        *([pa.array([a[5] for a, _ in some], pa.int64())] if percent is not None else []),
                    ],
                    names,
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + ", component_id long" * (percent is not None)
    return descending(docs, id_col, text_col, groups).mapInArrow(run, schema)
