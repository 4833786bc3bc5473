"""Session helpers: named columns and bounded count sketches. Tables are written and released by the library's lineage helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import materialise, new_path, release, share, tidy  # noqa: F401  (for this subpackage's modules)
from .arrays import give_back

SKETCH_PARTS, MERGED = 16, 256


def columns_named(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; others, clashing or not, never enter an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def hash_counts(df: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int, marks: bool = False) -> np.ndarray:
    """How often each value of 64-bit hashes, cut to their top ``bits`` bits, was emitted; marks: only whether, as packed bits.

    Each task fills one table and sends the SKETCH_PARTS pieces of it that it touched. Pieces are merged in two
    levels, MERGED of them first, one at a time, so memory is bounded whatever their number. The driver gets one table of 4 * 2 ** bits
    bytes (2 ** bits / 8 for marks) whatever the input's size. Counts stop at 2 ** 32 - 1.
    """
    size = (1 << bits) // SKETCH_PARTS
    names, schema = ["part", "task", "counts"], "part int, task int, counts binary"

    def piece(part: int, task: int, table: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([pa.compress(table.tobytes(), "zstd", asbytes=True)], pa.binary())], names)

    width = size // 8 if marks else size * 4

    def table_of(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, width, "zstd", asbytes=True), dtype=np.uint8 if marks else np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros((1 << bits) // 8, np.uint8) if marks else np.zeros(1 << bits, np.uint32)
        found = False
        for h in emit(batches):
            for lo in range(0, len(h), 1 << 20):
                at = (h[lo : lo + (1 << 20)] >> np.uint64(64 - bits)).astype(np.int64)
                found = True
                if marks:
                    np.bitwise_or.at(table, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
                else:
                    np.add.at(table, at, np.uint32(1))
        if found:
            for k in range(SKETCH_PARTS):
                step = len(table) // SKETCH_PARTS
                own = table[k * step : (k + 1) * step]
                if own.any():
                    yield piece(k, TaskContext.get().partitionId(), own)
        give_back()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width if marks else size, dtype=np.uint8 if marks else np.uint64)
        for b in batches:
            for x in b.column("counts"):
                total = total | table_of(x.as_py()) if marks else np.minimum(total + table_of(x.as_py()), 0xFFFFFFFF)
        yield piece(key[0].as_py(), key[1].as_py(), total.astype(np.uint8 if marks else np.uint32))

    pieces = df.mapInArrow(count, schema)
    for task in (F.floor(F.col("task") / MERGED).cast("int"), F.lit(0)):
        pieces = pieces.withColumn("task", task).groupBy("part", "task").applyInArrow(merge, schema)
    parts = {r["part"]: table_of(r["counts"]) for r in pieces.collect()}
    empty = np.zeros(width if marks else size, dtype=np.uint8 if marks else np.uint32)
    return np.concatenate([parts.get(k, empty) for k in range(SKETCH_PARTS)])


def marked(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the hashes' marks are set in a packed table; never false for a hash that was emitted."""
    at = hashes >> np.uint64(64 - bits)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
