"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text gives a fixed vector of statistics, transformed to be roughly Gaussian. A class's model is its share, mean
and shrunken covariance: (1 - shrinkage) * own + shrinkage * (pooled covariance mixed with its diagonal). The score is the
class probability from the difference of the Mahalanobis log-densities, by Cholesky factors that are computed once. The
fit uses every labelled row given to it, through class counts, sums and sums of products about the labelled rows' mean (a first
pass finds it, so nothing cancels), which add up by partition. Where no shrinkage is given, the largest of ``GRID`` is taken whose mean
log-loss over ``FOLDS`` folds (dealt by a hash of the id) of the labelled rows is the least or within ``TIE`` of it; the folds' sums come
from the same pass.

Null text is empty; an empty text has the statistics of an empty text and a score like any other. Labels other than 0
and 1, null labels and null ids are left out of the fit; several labels of an id each count, as do repeated rows. Without labels
of a class the other class's share decides (0.5 without any). Columns of any name are kept beside the score, which takes the place of
one named ``score``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER_CODE, distinct_sorted, owner, per_text, prefix_hash, slices, span_hash, words
from .runtime import materialise, release
from .spotsigs import ANCHORS, _anchor_table

#: Shrinkages tried where none is given, the folds they are tried on, and what counts as a tie in mean log-loss.
GRID, FOLDS, TIE = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7), 5, 1e-4
FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "exclaim", "symbol", "comma_stop", "distinct_words",
    "repeated_word", "line_length", "distinct_lines", "common_words", "capitalised", "high_bytes", "byte_entropy", "long_words", "stops_per_word",
)
_UPPER, _DIGIT, _EXCLAIM, _SYMBOL, _COMMA, _HIGH, _NEWLINE, _STOP = (np.zeros(256, dtype=bool) for _ in range(8))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_EXCLAIM[[33, 63]] = True
_SYMBOL[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = True
_COMMA[[44, 46, 58, 59]] = True
_HIGH[128:] = True
_NEWLINE[10] = True
_STOP[[46, 33, 63]] = True


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts by FEATURES, transformed."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    table = np.bincount(text_of * 256 + buf, minlength=256 * n).reshape(n, 256).astype(np.float64)
    share = lambda mask: table[:, mask].sum(axis=1) / np.maximum(size, 1)
    start, end = words(buf, offsets)
    cuts = per_text(start, offsets)
    count = np.diff(cuts).astype(np.float64)
    some, who = np.maximum(count, 1), owner(cuts)
    length = (end - start).astype(np.float64)
    by_text = lambda x: np.bincount(who, weights=x, minlength=n)
    mean = by_text(length) / some
    spread = np.sqrt(np.maximum(0, by_text(length**2) / some - mean**2))
    h = span_hash(prefix_hash(buf, LOWER_CODE), start, end)
    anchors = _anchor_table(tuple(ANCHORS.split()))
    common = anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (who[1:] == who[:-1])
    distinct = np.diff(distinct_sorted(h, cuts)[1])
    l_start, l_end = words(buf, offsets, _NEWLINE)
    l_cuts = per_text(l_start, offsets)
    lines = np.maximum(np.diff(l_cuts), 1)
    distinct_lines = np.diff(distinct_sorted(span_hash(prefix_hash(buf, LOWER_CODE), l_start, l_end), l_cuts)[1])
    p = table / np.maximum(size, 1)[:, None]
    entropy = -np.sum(np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0), axis=1)
    root = np.sqrt
    return np.column_stack(
        [
            np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread), root(share(_UPPER)), root(share(_DIGIT)), root(share(_EXCLAIM)), root(share(_SYMBOL)), root(share(_COMMA)),
            np.log1p(distinct) / np.log1p(some), root(by_text(again) / some), np.log1p(size / lines), distinct_lines / lines, by_text(common) / some,
            root(by_text(_UPPER[buf[start]] * 1.0) / some), root(share(_HIGH)), entropy, root(by_text((length > 20) * 1.0) / some), root(table[:, _STOP].sum(axis=1) / some),
        ]
    )


@dataclass(frozen=True)
class Model:
    """Log shares, means, and inverse Cholesky factors with log determinants, by class."""

    share: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    counts: tuple[int, int]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if not min(self.counts):
            total = sum(self.counts)
            return np.full(len(x), self.counts[1] / total if total else 0.5)
        density = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            density.append(self.share[c] - 0.5 * (z * z).sum(axis=1) - 0.5 * self.log_det[c])
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def model_of(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float, center: np.ndarray | float = 0.0, floor: float = 1e-4) -> Model:
    """A model from each class's count, sum and sum of products about ``center``."""
    d = len(FEATURES)
    n = [sums[c][0] if c in sums else 0 for c in (0, 1)]
    if not min(n):
        z = np.zeros
        return Model(z(2), z((2, d)), z((2, d, d)), z(2), (n[0], n[1]))
    mean = [sums[c][1] / n[c] for c in (0, 1)]
    cov = [sums[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
    factor, log_det = [], []
    for c in (0, 1):
        shrunk = (1 - shrinkage) * cov[c] + shrinkage * target + floor * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        factor.append(np.linalg.inv(lower))
        log_det.append(2 * np.log(np.diag(lower)).sum())
    return Model(np.log(np.array(n) / sum(n)), np.array(mean) + center, np.array(factor), np.array(log_det), (n[0], n[1]))


def _totals(rows: DataFrame, center: np.ndarray, products: bool) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """By fold and label: count, sum and, asked for, sum of products about ``center``. At most 2 * FOLDS rows of sums reach the driver a cell."""
    d = len(FEATURES)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            group, x = batch.column(1).to_numpy(), batch.column(0).flatten().to_numpy().reshape(-1, d) - center
            for g in np.unique(group).tolist():
                own = x[group == g]
                parts = [np.array([len(own)]), own.sum(axis=0)] + [(own.T @ own).ravel()] * products
                sums[g] = sums.get(g, 0) + np.concatenate(parts)
        for g, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), g), pa.int32()), pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["group", "cell", "value"])

    total = rows.select("x", (F.col("fold") * 2 + F.col("label")).alias("group")).mapInArrow(gather, "group int, cell int, value double").groupBy("group", "cell").agg(F.sum("value").alias("value"))
    flat: dict[int, np.ndarray] = {}
    for r in total.collect():  # 2 * FOLDS groups by 1 + d + d * d cells
        flat.setdefault(r["group"], np.zeros(1 + d + d * d))[r["cell"]] = r["value"]
    return {(g // 2, g % 2): (int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d)) for g, v in flat.items()}


def _added(totals: dict, folds: set[int]) -> dict[int, tuple]:
    """The sums of some folds by label."""
    out: dict[int, tuple] = {}
    for (fold, label), (n, s, p) in totals.items():
        if fold in folds:
            before = out.get(label, (0, 0.0, 0.0))
            out[label] = (before[0] + n, before[1] + s, before[2] + p)
    return out


def choose_shrinkage(rows: DataFrame, totals: dict, center: np.ndarray) -> float:
    """The largest shrinkage of GRID whose mean log-loss on left-out folds is within TIE of the least."""
    models = {(f, s): model_of(_added(totals, set(range(FOLDS)) - {f}), s, center) for f in range(FOLDS) for s in GRID}
    d = len(FEATURES)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(GRID))
        for batch in batches:
            x, label, fold = batch.column(0).flatten().to_numpy().reshape(-1, d), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in np.unique(fold).tolist():
                at = fold == f
                for k, s in enumerate(GRID):
                    p = np.clip(models[f, s].score(x[at]), 1e-12, 1 - 1e-12)
                    sums[k] -= np.log(np.where(label[at] == 1, p, 1 - p)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(GRID)), pa.int32()), pa.array(sums)], ["k", "loss"])

    found = {r["k"]: r["loss"] for r in rows.select("x", "label", "fold").mapInArrow(losses, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
    n = max(1, sum(v[0] for v in totals.values()))
    return max((GRID[k] for k in found if found[k] <= min(found.values()) + TIE * n), default=GRID[-1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", shrinkage: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on all rows of ``docs`` that ``labels`` marks 0 or 1."""
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("marked"), F.col(f"`{label_col}`").cast("int").alias("label")).where("marked IS NOT NULL AND label IN (0, 1)")
    d = len(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in slices(batch.column(1)):
                x = statistics(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float64()))], ["id", "x"])

    # Texts are measured where they lie: only d numbers a document meet the labels, and only labelled ones are kept.
    ids = F.col(f"`{id_col}`").cast("long").alias("id")
    rows = docs.select(ids, F.col(f"`{text_col}`").alias("text")).mapInArrow(measure, "id long, x array<double>").join(marks, F.col("id") == F.col("marked"))
    rows = materialise(rows.select("x", "label", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    first = _added(_totals(rows, np.zeros(d), False), set(range(FOLDS)))
    n = sum(v[0] for v in first.values())
    center = sum((v[1] for v in first.values()), np.zeros(d)) / max(n, 1)
    totals = _totals(rows, center, True)
    model = model_of(_added(totals, set(range(FOLDS))), choose_shrinkage(rows, totals, center) if shrinkage is None else shrinkage, center)
    release(rows)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs and ``score``, the probability of class 1 of each whole text."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"])
    at, schema = docs.columns.index(text_col), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    names = [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(statistics(buf, off)) for _, _, buf, off in slices(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names)

    return docs.mapInArrow(run, schema)
