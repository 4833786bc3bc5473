"""Best-fit decreasing packing of token sequences, planned on the histogram of piece lengths.

Documents longer than a window are first cut into full windows; what is left of each document is one piece. Best-fit
decreasing looks at lengths alone, so the plan needs only how many pieces there are of each length: at most ``window``
counts, whatever the corpus. The driver places lengths in decreasing order; a segment tree indexed by remaining capacity
finds the tightest open window, and all alike windows take all alike pieces at once. The plan says which ranks of which
length go to which sequences at which offset. Pieces get their ranks from counts by partition, so a length that a third of
all pieces have is ranked in parallel.

Sequences are to be padded to the window, except at a length that is a power of two, which is used as it is (``padding``). Best-fit
decreasing fills all but a few windows, so the exception needs no plan of its own.

Null text is empty; with an end token every document has at least one piece, without one empty documents have none.
Repeated rows are packed each; null ids stay null. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import slices
from .runtime import columns_named, materialise
from .tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Segment tree over remaining capacities 0..size: the smallest with an open window that is at least some length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` with an open window, or -1."""
        at = least + self.leaves
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def plan(lengths: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) for a histogram of piece lengths.

    Sequences of equal remaining capacity are kept as ranges; a step takes a whole range or the part of it that it needs.
    """
    tree, open_ranges, out, sequences = CapacityTree(window), {}, [], 0
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                # Nothing open fits: new windows, each filled with as many of these as go in (what best fit would do, as
                # the window just opened is the tightest until it is full).
                each = window // length
                whole, rest = divmod(left, each)
                for k in range(each):
                    if whole:
                        out.append((length, rank, whole, sequences, k * length))
                        rank += whole
                if whole and (room := window - each * length):
                    open_ranges.setdefault(room, []).append((sequences, whole))
                    tree.add(room, whole)
                sequences += whole
                for k in range(rest):
                    out.append((length, rank, 1, sequences, k * length))
                    rank += 1
                if rest:
                    open_ranges.setdefault(window - rest * length, []).append((sequences, 1))
                    tree.add(window - rest * length, 1)
                    sequences += 1
                left = 0
                continue
            first, have = open_ranges[capacity].pop()
            # A window with room for several of this length is filled on before the next one is touched.
            each = min(capacity // length, left)
            take = min(have, max(1, left // each))
            if take < have:
                open_ranges[capacity].append((first + take, have - take))
            tree.add(capacity, -take)
            for k in range(each):
                out.append((length, rank, take, first, window - capacity + k * length))
                rank += take
            left -= take * each
            if room := capacity - each * length:
                open_ranges.setdefault(room, []).append((first, take))
                tree.add(room, take)
    return out


def padding(fills: list[int], window: int = 2048) -> int:
    """The tokens that pad sequences of these lengths: to the window, but none where the length is a power of two."""
    return sum(0 if n & (n - 1) == 0 else window - n for n in fills)


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int | None = 1, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, and its ids (little-endian unsigned 32 bits) if kept."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, False)
        for batch in batches:
            ids_of = batch.column(0).cast(pa.int64())
            for lo, hi, buf, off in slices(batch.column(1)):
                ids, cuts = enc.encode(buf, off)
                docs_of, start, length, crc, total, raw = [], [], [], [], [], []
                for i in range(hi - lo):
                    own = ids[cuts[i] : cuts[i + 1]].astype("<u4")
                    if end_id is not None:
                        own = np.append(own, np.array([end_id], dtype="<u4"))
                    data = memoryview(own.tobytes())
                    for s in range(0, len(own), window):
                        part = data[4 * s : 4 * (s + window)]
                        docs_of.append(lo + i)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(own))
                        if keep_ids:
                            raw.append(bytes(part))
                columns = [ids_of.take(pa.array(docs_of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * keep_ids, names)

    return columns_named(docs, id_col, text_col).mapInArrow(run, PIECE + ", ids binary" * keep_ids)


def pack(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``window``; every sequence is gapless from 0."""
    kept = materialise(pieces.withColumn("_part", F.spark_partition_id()), "pieces")
    counts = kept.groupBy("_part", "length").agg(F.count("*").alias("n"))
    # The first rank of each partition's pieces of a length: a window over counts, one row a partition and length.
    first = counts.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    steps = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    by_length: dict[int, list] = {}
    for s in steps:
        by_length.setdefault(s[0], []).append(s)
    tables = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(v, key=lambda s: s[1]))) for k, v in by_length.items()}
    names = [c for c in kept.columns if c != "_part"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_part") + ", sequence_id long, offset long"

    def place(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int] = {}
        for b in batches:
            length, base = b.column("length").to_numpy(), b.column("_first").to_numpy()
            rank = np.empty(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], length[order][1:] != length[order][:-1]])) if len(order) else []
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for lo, hi in zip(begin, [*begin[1:], len(order)]):
                at = order[lo:hi]
                n = int(length[at[0]])
                rank = base[at] + done.get(n, 0) + np.arange(len(at))
                done[n] = done.get(n, 0) + len(at)
                _, ranks, _, firsts, offsets = tables[n]
                step = np.searchsorted(ranks, rank, side="right") - 1
                sequence[at], offset[at] = firsts[step] + rank - ranks[step], offsets[step]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    joined = kept.join(first.select(F.col("_part").alias("_p"), F.col("length").alias("_l"), F.coalesce("first", F.lit(0)).alias("_first")), (F.col("_part") == F.col("_p")) & (F.col("length") == F.col("_l"))).drop("_p", "_l")
    return joined.groupBy("_part").applyInArrow(place, schema)
