"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Each vector is scaled to length 1, filled up with zeros to ``BITS`` dimensions at least, rotated by a seeded random orthogonal matrix (by rounds
of sign flips and fast Hadamard transforms where the dimension is large) and kept as the packed signs of its D coordinates with a
correction scalar f = <signs / sqrt(D), rotated>. For a query q the inner product is estimated as <signs / sqrt(D), q> / f, with an
error of at most eps * sqrt((1 - f^2) / f^2) * sqrt(1 - <signs / sqrt(D), q>^2) / sqrt(D - 1) but for a chance that falls exponentially in eps^2.

Every vector is encoded once, every query rotated once. Only ids, codes and scalars (D / 8 + 16 bytes a vector) meet the
rotated queries (4 D bytes each): both are cut into blocks of bounded size, large ones so that little is copied, and every pair of
blocks is a unit of work of its own, so nothing is broadcast and no group is gathered. There the codes are unpacked slice by slice,
for all queries of the block at once. The sizes of blocks and slices have no bearing on the result.

A first pass over the codes' first ``ROUGH`` bytes finds each query's ``8 k`` best rough estimates; the k-th best true cosine of these is a
floor that the k nearest reach. A second pass over the whole codes leaves the candidates whose upper bound reaches the floor. Their
original vectors, and no others, are fetched and ranked by cosines in double precision. What is left out cannot be among the
nearest within that chance.

A hot vector (a third of all rows alike) is compared once: equal vectors are one class before all, kept with its k + 1
smallest ids, which hold all that any query can return of it.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or candidates; nor do
rows with a null id. Vectors of another length than the query's are no candidates of it. Rows that repeat an id count
once, with the smallest vector. Components are scaled by the largest one, so no finite vector overflows. Ties go to the smaller
id. Fewer than k candidates: all are returned. Empty tables give an empty result; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import columns_named, materialise, tidy

CODE = "cls long, dim int, code binary, f double"
#: The least number of bits of a code; the bytes of it that the first pass reads; up to which dimension rotations are matrices.
BITS, ROUGH, _WHOLE = 1024, 16, 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        pair = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


class Rotation:
    """A random orthogonal map into ``BITS`` dimensions or more: the same for the same arguments. Large ones are a power of two."""

    def __init__(self, dim: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.matrix = max(dim, BITS), None
        if self.dim <= _WHOLE:
            q, r = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))
            self.matrix = (q * np.sign(np.diag(r)))[:dim]
        else:
            self.dim = 1 << (self.dim - 1).bit_length()
            self.signs = rng.choice([-1.0, 1.0], size=(3, self.dim))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return x @ self.matrix
        x = np.pad(x, ((0, 0), (0, self.dim - x.shape[1])))
        for s in self.signs:
            x = _hadamard(x * s)
        return x


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> Rotation:
    """A worker's rotation, made once."""
    return Rotation(dim, seed)


def unit(vectors: np.ndarray) -> np.ndarray:
    """The rows at length 1; scaled by their largest components first, so nothing overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(vectors: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction scalars of the rows."""
    turned = turn(unit(vectors))
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turn.dim)


def sums(codes: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """<signs / sqrt(D), query>, queries by codes, over the first bytes where the codes hold no more."""
    bits = min(8 * codes.shape[1], turned.shape[1])
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32)
    signs *= 2
    signs -= 1
    return (turned[:, :bits].astype(np.float32) @ signs.T) / np.float32(np.sqrt(turned.shape[1]))


def bounds(codes: np.ndarray, f: np.ndarray, turned: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the cosines, queries by codes, and bounds of their errors, from codes and scalars alone."""
    s, f = sums(codes, turned), f.astype(np.float32)
    slack = np.float32(eps / np.sqrt(max(turned.shape[1] - 1, 1))) * np.sqrt(np.maximum(0, 1 - f * f)) / f
    return s / f, slack * np.sqrt(np.maximum(0, 1 - s * s)) + np.float32(1e-5)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; each row's result depends on that row alone."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore", divide="ignore"):
        top = (a * b).sum(axis=1)
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        out = top / (np.sqrt(aa) * np.sqrt(bb))
        odd = ~(np.isfinite(top) & np.isfinite(aa) & np.isfinite(bb) & (aa > 1e-200) & (bb > 1e-200))
    if odd.any():
        x, y = unit(a[odd]), unit(b[odd])
        out[odd] = (x * y).sum(axis=1)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _encoded(classes: DataFrame, seed: int) -> DataFrame:
    """cls, dim, code, f of each vector. classes: cls, dim, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                turn = rotation(dim, seed)
                for lo in range(0, own.num_rows, max(1, (1 << 19) // dim)):
                    some = own.slice(lo, max(1, (1 << 19) // dim))
                    codes, f = encode(_matrix(some.column("v"), dim), turn)
                    yield pa.RecordBatch.from_arrays([some.column("cls"), some.column("dim"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(f)], ["cls", "dim", "code", "f"])

    return classes.mapInArrow(run, CODE)


def _rotated(queries: DataFrame, seed: int) -> DataFrame:
    """query, dim, alone, turned: each query's rotated vector of length 1. queries: query, dim, alone, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                turned = rotation(dim, seed)(unit(_matrix(own.column("v"), dim))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("query", "dim", "alone")), pa.array(list(turned), pa.list_(pa.float32()))], ["query", "dim", "alone", "turned"])

    return queries.mapInArrow(run, "query long, dim int, alone long, turned array<float>")


def _by_blocks(codes: DataFrame, queries: DataFrame, block_rows: int, query_block_rows: int, search) -> DataFrame:
    """query, cls, estimate of what ``search`` finds in every pair of a block of codes and one of queries.

    codes: cls, dim, code, f. queries: query, dim, alone, turned, floor. search gets slices of a block of codes one after the other (codes,
    scalars, and which pairs of a query and a code are of one vector alone) and gives places in queries and slice and estimates.
    """
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, m = codes.count(), queries.count()
    nc = max(1, -(-n // block_rows))
    nq = max(1, -(-m // query_block_rows), min(-(-parts // nc), -(-m // 64)))  # small tables are spread over the tasks there are
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    c = codes.select("dim", F.pmod(F.xxhash64("cls"), F.lit(nc)).cast("int").alias("block"), every(nq).alias("qblock"), F.lit(1).alias("side"), F.col("cls").alias("id"), none("long").alias("own"), "code", "f", none("array<float>").alias("turned"))
    q = queries.select("dim", every(nc).alias("block"), F.pmod(F.xxhash64("query"), F.lit(nq)).cast("int").alias("qblock"), F.lit(0).alias("side"), F.col("query").alias("id"), F.col("alone").alias("own"), none("binary").alias("code"), F.col("floor").alias("f"), "turned")
    keys = ["dim", "block", "qblock"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .ngram_join import _Runs, run_starts

        for r in _Runs([*keys, "side", "id", "own", "code", "f", "turned"], 3).feed(batches):
            begin = run_starts(r, keys)
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), r.num_rows]):
                one = r.slice(lo, hi - lo)
                m = int((one.column("side").to_numpy() == 0).sum())
                if not 0 < m < hi - lo:
                    continue
                asked, rest = one.slice(0, m), one.slice(m)
                code = np.frombuffer(b"".join(rest.column("code").to_pylist()), np.uint8).reshape(hi - lo - m, -1)
                f, ids = rest.column("f").to_numpy(zero_copy_only=False), rest.column("id").to_numpy()
                turned = np.stack(asked.column("turned").to_numpy(zero_copy_only=False))
                query, own = asked.column("id").to_numpy(), asked.column("own").fill_null(-1).to_numpy()
                floor = asked.column("f").fill_null(-2.0).to_numpy()
                step = max(1, (1 << 22) // (8 * code.shape[1]))
                some = [slice(k, min(k + step, len(ids))) for k in range(0, len(ids), step)]
                # A query that is all of its class is no candidate of its own.
                for i, j, estimate in search(((k.start, code[k], f[k], own[:, None] == ids[None, k]) for k in some), turned, floor):
                    yield pa.RecordBatch.from_arrays([pa.array(query[i]), pa.array(ids[j]), pa.array(estimate.astype(np.float64))], ["query", "cls", "estimate"])

    return c.unionByName(q).repartition(parts, *keys).sortWithinPartitions(*keys, "side", "id").mapInArrow(run, "query long, cls long, estimate double")


def _cosines(pairs: DataFrame) -> DataFrame:
    """The rows with ``score``, the cosine of the columns v and w, in their place."""
    names = [c for c in pairs.columns if c not in ("v", "w")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in names) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                for lo in range(0, own.num_rows, max(1, (1 << 19) // dim)):
                    some = own.slice(lo, max(1, (1 << 19) // dim))
                    score = cosine(_matrix(some.column("v"), dim), _matrix(some.column("w"), dim))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(score)], [*names, "score"])

    return pairs.withColumn("dim", F.size("v")).select(*names, "v", "w", "dim").mapInArrow(run, schema)


@tidy("nearest")
def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            eps: float = 4.0, seed: int = 7, block_rows: int = 1 << 18, query_block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest vectors other than itself."""

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`").cast("array<double>")
        fine = F.col(f"`{id_col}`").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
        kept = columns_named(df, id_col, vector_col).where(F.coalesce(fine, F.lit(False)))
        return kept.groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(F.min(v).alias("v"))

    # Equal vectors are one class, numbered when it is written, with its k + 1 smallest ids and how many it has.
    owned = usable(vectors)
    order = Window.partitionBy("hash", "v").orderBy("id")
    least = owned.withColumn("hash", F.xxhash64("v")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    grouped = least.groupBy("hash", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialise(grouped.select(F.monotonically_increasing_id().alias("cls"), F.size("v").alias("dim"), "v", "hash", "ids"), "ann")
    codes = materialise(_encoded(classes.select("cls", "dim", "v"), seed), "codes")
    asked = usable(queries).withColumn("dim", F.size("v"))
    # A query that is its class's only vector has no candidate there.
    single = classes.where("size(ids) = 1").select(F.col("cls").alias("alone"), F.element_at("ids", 1).alias("id"))
    asked = materialise(asked.join(single, "id", "left").select(F.col("id").alias("query"), "dim", "v", "alone"), "queries")
    turned = materialise(_rotated(asked, seed).withColumn("floor", F.lit(None).cast("double")), "rotated")
    m = 8 * k

    def rough(parts: Iterator[tuple], query: np.ndarray, _: np.ndarray) -> Iterator[tuple]:
        best, at = np.full((len(query), 0), -np.inf, np.float32), np.zeros((len(query), 0), np.int64)
        for start, code, f, out in parts:
            estimate = sums(code[:, :ROUGH], query) / f.astype(np.float32)
            estimate[out] = -np.inf
            best, at = np.concatenate([best, estimate], axis=1), np.concatenate([at, np.broadcast_to(start + np.arange(len(f)), estimate.shape)], axis=1)
            keep = np.argpartition(-best, min(m, best.shape[1]) - 1, axis=1)[:, :m]
            best, at = np.take_along_axis(best, keep, axis=1), np.take_along_axis(at, keep, axis=1)
        i, j = np.nonzero(best > -np.inf)
        yield i, at[i, j], best[i, j]

    def whole(parts: Iterator[tuple], query: np.ndarray, floor: np.ndarray) -> Iterator[tuple]:
        for start, code, f, out in parts:
            estimate, error = bounds(code, f, query, eps)
            i, j = np.nonzero((estimate + error >= (floor[:, None] - 1e-5).astype(np.float32)) & ~out)
            yield i, start + j, estimate[i, j]

    def scored(pairs: DataFrame) -> DataFrame:
        """query_id, vec_id, score of every vector of the pairs' classes but the query itself."""
        both = pairs.join(classes.select("cls", F.col("v").alias("w"), "ids"), "cls").join(asked.select("query", "v"), "query")
        every = _cosines(both.select("query", "ids", "v", "w")).select(F.col("query").alias("query_id"), F.explode("ids").alias("vec_id"), "score")
        return every.where("query_id <> vec_id")

    best = Window.partitionBy("query").orderBy(F.desc("estimate"), "cls")
    few = _by_blocks(codes, turned, block_rows, query_block_rows, rough).withColumn("place", F.row_number().over(best)).where(F.col("place") <= m).select("query", "cls")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # The k-th best of some true cosines; without k of them all candidates are ranked.
    floors = scored(few).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(F.col("query_id").alias("query"), F.col("score").alias("least"))
    turned = materialise(turned.drop("floor").join(floors, "query", "left").withColumnRenamed("least", "floor"), "floors")
    left = materialise(_by_blocks(codes, turned, block_rows, query_block_rows, whole).select("query", "cls"), "likely")
    return scored(left).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
