"""N-gram Jaccard join with set-relation skipping.

A document's set: the distinct ``width``-word shingles of its whole text, as 64-bit hashes; a shorter text's whole word
sequence is one shingle; without words the set is empty and links with nothing. Two sets link when
100 * intersection >= percent * union.

1. Sets are ordered by a bounded sketch of shingle frequencies (rare first), then by hash. Equal sets become one class.
2. A class posts the prefix of its set that any partner must share, with size and position. Index lists are dealt by range
   of (shingle, size, position), so a hot list is spread over tasks, and cut into blocks. Lists of up to three entries give
   their pairs at once. In a longer one the class with the largest share of its prefix in such lists leads and is paired with all.
3. Pairs that counts by hash bucket rule out are gone; the others are verified exactly, and the verified links make
   components. Of the leaders that a class is near to, the one most followed becomes its own, with the difference to it.
4. Classes of one leader are answered from their differences to it: two sets differ by as much as their differences differ.
   A class that its leader does not link with has to share elements of its difference with any partner, so differences are
   joined by prefixes of what recurs among them, rare first, through lists and blocks as in step 5.
5. Long lists of several components are read again. Where they hold many more pairs of different components than entries,
   a few pairs an entry are drawn and verified first, in rounds, so a group of near copies that its leader does not link with
   becomes one component without all its pairs. The rest is read block against block. A pair of blocks is skipped when its
   sizes, its positions, its components or its leaders leave nothing to find, a pair of classes when one of these or its
   bucket counts do. Few are left to verify.
Only pairs that cannot link or whose ends are linked already are skipped, so components are exact; no list or group is
expanded into all its pairs.

Null text is empty. A null id takes part in no link and has no component. Each distinct set of a repeated id takes part, and
the id links them: its rows share a component, but for rows without words, whose component is their own id. Equal sets are
linked. Further columns, of whatever name, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER_CODE, binary_column, distinct_sorted, give_back, mix, owner, per_text, prefix_hash, ragged, shingles, slices, span_hash, words
from .graph import components
from .runtime import columns_named, hash_counts, marked, materialise, release, share, tidy

#: Texts (bytes, offsets) to their sets (ascending distinct 64-bit hashes, offsets).
Sets = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
SKETCH_BITS, MARK_BITS, BLOCK, CHUNK, SHORT_BITS = 21, 26, 256, 256, 6
#: Pairs an entry above which pairs are drawn first; those drawn an entry and round; rounds in a row that may take away less than a quarter.
MANY, NEXT, STALLS = 4, 4, 2
#: Up to so many ids travel themselves (8 bytes each), more as marks of 2 ** MARK_BITS bits.
FEW = 1 << 20


def sets_of(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending hash order, and the offsets by text."""
    start, end = words(buf, offsets)
    h, cuts = shingles(span_hash(prefix_hash(buf, LOWER_CODE), start, end), per_text(start, offsets), width)
    return distinct_sorted(h, cuts)


def needed(a, b, percent: int):
    """The least intersection of sets of sizes a and b that link: ceil(percent * (a + b) / (100 + percent))."""
    return -(-percent * (a + b) // (100 + percent))


def set_hashes(v: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """Two sums that stand for each set."""
    upto = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(v, s), dtype=np.uint64)]) for s in (101, 202))
    return [(u[cuts[1:]] - u[cuts[:-1]]).view(np.int64) for u in upto]


def frequency_class(counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """0 for shingles that the sketch can't tell from rare ones, then one class for each doubling.

    A cell holds the rare ones' mean beside its own shingle's count, give or take a few of its square roots.
    """
    mean = counts.mean()
    over = (counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] - mean) / (4 * np.sqrt(mean) + 8)
    return np.floor(np.log2(np.maximum(over, 1) + 1e-9)).clip(0).astype(np.uint64)


def signatures(v: np.ndarray, cuts: np.ndarray, most_bits: int = 62) -> tuple[np.ndarray, np.ndarray]:
    """Each set's element counts by hash bucket (half as many buckets as elements, a power of two), and the offsets by text.

    The sum of the smaller counts, bucket by bucket, is never less than the intersection: what it rules out has no link.
    """
    n = np.diff(cuts)
    bits = np.minimum(np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64), most_bits)
    size = np.where(n > 0, 1 << bits, 0)
    at = np.concatenate([[0], np.cumsum(size)])
    who = owner(cuts)
    bucket = np.where(bits[who] > 0, (v >> np.uint64(1)) >> (63 - bits[who]).astype(np.uint64), 0).astype(np.int64)
    counts = np.bincount(at[:-1][who] + bucket, minlength=int(at[-1]))
    return np.minimum(counts, 255).astype(np.uint8), at


def binaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and the offsets by row."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _folded(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, size: int, width: int) -> np.ndarray:
    """The rows' signatures, all of one size, over fewer buckets; a full count (255) stands for any number."""
    own = data[offsets[rows][:, None] + np.arange(size)].astype(np.uint32)
    own[own == 255] = 1 << 20
    return own.reshape(len(rows), width, size // width).sum(axis=2, dtype=np.uint32)


def may_share(x: pa.Array, y: pa.Array, least: np.ndarray) -> np.ndarray:
    """Which pairs of signatures, row by row, leave room for so large an intersection."""
    (dx, ox), (dy, oy) = binaries(x), binaries(y)
    nx, ny = np.diff(ox), np.diff(oy)
    ok = np.zeros(len(least), dtype=bool)
    for a, b in np.unique(np.stack([nx, ny], axis=1), axis=0) if len(least) else []:
        width = int(min(a, b))
        rows = np.flatnonzero((nx == a) & (ny == b))
        step = max(1, (1 << 19) // int(max(a, b, 1)))
        for lo in range(0, len(rows) if width else 0, step):
            some = rows[lo : lo + step]
            common = np.minimum(_folded(dx, ox, some, int(a), width), _folded(dy, oy, some, int(b), width)).sum(axis=1, dtype=np.int64)
            ok[some] = common >= least[some]
    return ok


class _Runs:
    """Cuts sorted batches into whole runs of equal keys (one or two columns, named first), holding the unfinished run."""

    def __init__(self, names: list[str], keys: int = 1):
        self.names, self.keys, self.held = names, names[:keys], []

    def feed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            b = b.select(self.names)
            begin = run_starts(b, self.keys)
            cut = int(begin[-1])  # the last run may go on
            goes_on = not self.held or all(self.held[0].column(k)[0].as_py() == b.column(k)[0].as_py() for k in self.keys)
            if not goes_on:
                yield self._join()
            if cut:
                self.held.append(b.slice(0, cut))
                yield self._join()
            self.held.append(b.slice(cut))
        if self.held:
            yield self._join()
        give_back()

    def _join(self) -> pa.RecordBatch:
        parts, self.held = self.held, []
        return pa.concat_batches(parts) if len(parts) > 1 else parts[0]


def run_starts(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows at which a sorted batch's keys change."""
    new = np.zeros(b.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = b.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _index(docs: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """doc_id, n, s1, s2, prefix, sig, short: size, two set hashes, the prefix in the common order, bucket signatures."""

    def shingles_in(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for _, _, buf, off in slices(b.column(1)):
                yield sets(buf, off)[0]

    counts = hash_counts(docs, shingles_in, SKETCH_BITS)
    shared = share(docs.sparkSession, counts)  # 4 * 2 ** SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in slices(batch.column(1)):
                v, cuts = sets(buf, off)
                n = np.diff(cuts)
                # rare first: the class goes above the hash's top bits, which is one total order for all documents
                key = (frequency_class(shared.value, v) << np.uint64(58)) | (v >> np.uint64(6))
                ordered = v[np.lexsort((v, key, np.repeat(np.arange(len(n)), n)))]
                take = np.where(n > 0, prefix_size(n, percent), 0)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n), *map(pa.array, set_hashes(v, cuts)),
                     binary_column(ordered[ragged(cuts[:-1], take)], np.concatenate([[0], np.cumsum(take)])), binary_column(*signatures(v, cuts)), binary_column(*signatures(v, cuts, SHORT_BITS))],
                    ["doc_id", "n", "s1", "s2", "prefix", "sig", "short"],
                )

    made = materialise(docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix binary, sig binary, short binary"), "sets")
    release(shared)  # else a copy of it stays on each executor's disk
    return made


def prefix_size(n, percent: int):
    """How many of n elements, in the common order, hold one of every partner's at least."""
    return n - -(-percent * n // 100) + 1


def length_partition(n: np.ndarray, percent: int) -> np.ndarray:
    """The partition of sets of these sizes: starts are 1 and then the least size that can't link with the start before.

    Sets that link lie in one partition or in two that follow one another.
    """
    starts = [1]
    while starts[-1] <= int(n.max(initial=0)):
        starts.append(100 * starts[-1] // percent + 1)
    return np.searchsorted(np.array(starts), n, side="right") - 1


def _postings(classes: DataFrame, percent: int, by_length: bool) -> DataFrame:
    """token, n, pos, cls: one row a prefix shingle; by length: one in its own partition's list and one in the next partition's."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, n = b.column("token").to_numpy().view(np.uint64), b.column("n").to_numpy()
            part = length_partition(n, percent)
            for k in (0, 1):
                yield b.set_column(0, "token", pa.array((token ^ mix((part + k).astype(np.uint64), 53)).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = binaries(b.column("prefix"))
            size = np.diff(offsets) // 8
            columns = [data.view(np.int64), np.repeat(b.column("n").to_numpy(), size), ragged(np.zeros(len(size), np.int64), size), np.repeat(b.column("cls").to_numpy(), size)]
            for lo in range(0, len(columns[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 17)]) for c in columns], ["token", "n", "pos", "cls"])

    schema = "token long, n long, pos long, cls long"
    found = classes.mapInArrow(run, schema)
    return found.mapInArrow(dealt, schema) if by_length else found


def has_partner(token: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, sorted by token and size, have another one in their list that sizes, and their own position, let link."""
    run = np.cumsum(np.append(False, token[1:] != token[:-1])) << 40
    lo = np.searchsorted(run + n, run + -(-percent * n // 100))
    hi = np.searchsorted(run + n, run + 100 * n // percent, side="right")
    at = np.arange(len(n))
    least = n[np.minimum(np.where(lo < at, lo, at + 1), max(len(n) - 1, 0))]  # the smallest of the others
    return (hi - lo > 1) & (n - pos >= needed(n, least, percent))


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """Rows with b: a pair of a list of two or three. Rows without: an entry (a) of a longer one, with its length partition and its block.

    Entries without a partner of a size that could link are left out. Postings are dealt by range, so a hot list goes to several
    tasks; what lies at a task's ends may go on in another one.
    """
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["token", "n", "pos", "cls"]
    names = ["token", "n", "pos", "part", "block", "a", "b"]

    def blocks_of(r: pa.RecordBatch, edges: tuple, done: int) -> tuple[list[pa.RecordBatch], int]:
        token, n, pos, cls = (r.column(k).to_numpy() for k in order)
        open_end = np.isin(token, edges)
        for _ in range(2):  # what goes may leave others without a partner
            kept = open_end | has_partner(token, n, pos, percent)
            token, n, pos, cls, open_end = (x[kept] for x in (token, n, pos, cls, open_end))
        if not len(token):
            return [], done
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(begin, len(token)))
        longer = (size > 3) | open_end[begin]
        out = []
        # Lists of two and three: the entries at distance one and two.
        pairs = []
        for k in (1, 2):
            first = np.concatenate([begin[~longer & (size > j)] + j - k for j in range(k, 3)])
            pairs.append(np.stack([first, first + k]))
        a, b = np.concatenate(pairs, axis=1)
        ok = (100 * n[a] >= percent * n[b]) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= needed(n[a], n[b], percent))
        if ok.any():
            pair = np.unique(np.sort(np.stack([cls[a[ok]], cls[b[ok]]], axis=1), axis=1), axis=0)
            none = [pa.nulls(len(pair), pa.int64())] * 5
            out.append(pa.RecordBatch.from_arrays([*none, pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names))
        if longer.any():
            more = np.repeat(longer, size)
            within = np.arange(len(token)) - np.repeat(begin, size)
            new = more & (within % BLOCK == 0)
            block = (done + np.cumsum(new) - 1)[more]
            done += int(new.sum())
            out.append(pa.RecordBatch.from_arrays([*(pa.array(x[more]) for x in (token, n, pos)), pa.array(length_partition(n[more], percent)), pa.array(block), pa.array(cls[more]), pa.nulls(int(more.sum()), pa.int64())], names))
        return out, done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done, first, held = TaskContext.get().partitionId() << 40, None, None
        for r in _Runs(order).feed(batches):
            if first is None:
                first = r.column("token")[0].as_py()
            if held is not None:
                found, done = blocks_of(held, (first,), done)
                yield from found
            held = r
        if held is not None:
            found, done = blocks_of(held, (first, held.column("token")[len(held) - 1].as_py()), done)
            yield from found

    dealt = postings.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "token long, n long, pos long, part long, block long, a long, b long")


def _leader_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """a, b: the leader of each long list (by length partition) with every other class of it."""
    share = F.count("*") / (F.first("n") - F.expr(f"({percent} * first(n) + 99) div 100") + 1)
    scores = entries.groupBy("a").agg(share.alias("score"))
    scored = entries.select("token", "part", "a").join(scores, "a")
    heads = scored.groupBy("token", "part").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("head"))
    return entries.select("token", "part", F.col("a").alias("b")).join(heads, ["token", "part"]).where("head <> b").select(F.col("head").alias("a"), "b").distinct()


def _block_pairs(entries: DataFrame, left: Column, spans: list[str], apart: list[str], rule: Callable[[str, str], str]) -> DataFrame:
    """x, y, block: of every pair (x, y) of blocks of a list that may hold something to find, each block once.

    left: what follows an entry's position. spans: columns of which a block's least and most are needed by ``rule``, SQL over the
    two summaries. apart: a pair of blocks in which all entries agree in one of these columns holds nothing.
    """
    ends = [f(c).alias(f"{c}_{side}") for c in dict.fromkeys([*spans, *apart]) for side, f in (("lo", F.min), ("hi", F.max))]
    blanks = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_none") for c in apart]
    summary = materialise(entries.groupBy("token", "block").agg(F.max(left).alias("left"), *ends, *blanks), "blocks")
    mixed = " AND ".join(f"NOT (x.{c}_none + y.{c}_none = 0 AND least(x.{c}_lo, y.{c}_lo) = greatest(x.{c}_hi, y.{c}_hi))" for c in apart)
    pairs = summary.alias("x").join(summary.alias("y"), F.expr(f"x.token = y.token AND x.block <= y.block AND ({mixed}) AND {rule('x', 'y')}"))
    pairs = pairs.select(F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    return pairs.select("x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("block"))


def _pairs_of_blocks(entries: DataFrame, blocks: DataFrame, names: list[str], test: Callable[[dict, pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """a < b: classes of the pairs of blocks that pass ``test``; block pairs are dealt over all tasks, whatever their list."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["x", "y", "block", "cls", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _Runs(names, 2).feed(batches):
            begin, found = run_starts(r, ["x", "y"]), []
            for lo, hi in zip(begin, np.append(begin[1:], r.num_rows)):
                own = r.slice(lo, hi - lo)
                cols = {c: own.column(c).to_numpy(zero_copy_only=False) for c in names if not pa.types.is_binary(own.column(c).type)}
                two = cols["x"][0] != cols["y"][0]
                first = cols["block"] == cols["x"]
                p, q = np.flatnonzero(first), np.flatnonzero(~first) if two else np.arange(len(first))
                p, q = np.repeat(p, len(q)), np.tile(q, len(p))
                if not two:
                    p, q = p[p < q], q[p < q]
                ok = test(cols, own, p, q)
                if ok.any():
                    found.append(np.sort(np.stack([cols["cls"][p[ok]], cols["cls"][q[ok]]], axis=1), axis=1))
            if found:
                pair = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["a", "b"])

    work = blocks.join(entries, "block").select(*names)
    return work.repartition(parts, "x", "y").sortWithinPartitions("x", "y", "block").mapInArrow(run, "a long, b long")


def _pairs_left(entries: DataFrame, apart: list[str]) -> tuple[float, int]:
    """At most so many pairs of the lists differ in all columns of ``apart``, and the number of entries."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).cast("long").alias("value")) for i, c in enumerate(apart)))).alias("x")
    counts = entries.select("token", values).groupBy("token", "x.kind", "x.value").agg(F.count("*").cast("double").alias("k"))
    n = [F.sum(F.when(F.col("kind") == i, F.col("k"))) for i in range(len(apart))]
    left = [(n[i] * n[i] - F.sum(F.when(F.col("kind") == i, F.col("k") * F.col("k")))) / 2 for i in range(len(apart))]
    lists = counts.groupBy("token").agg((F.least(*left) if len(left) > 1 else left[0]).alias("left"), n[0].alias("n"))
    left, n = lists.agg(F.sum("left"), F.sum("n").cast("long")).first()
    return left or 0.0, n or 0


def _drawn(entries: DataFrame, apart: list[str], fits: str, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """The entries with the components that links of drawn pairs make, and these links (a, b), a table a round.

    entries: token, cls, component and what ``fits`` needs, SQL over two entries x and y of a list. In a round an entry meets the NEXT ones
    after it in its list, in an order drawn anew for each list and round, long lists in parts of about BLOCK drawn anew: so a
    group of many links becomes one component in a few rounds of at most NEXT rows an entry. Rounds go on while many pairs that may fit
    are left and a round takes away a quarter. Where they end decides how many pairs the blocks still have to look at, never what is found.
    """
    links: list[DataFrame] = []
    before, stalled, given = None, 0, entries
    while True:
        left, n = _pairs_left(entries, apart)
        stalled = stalled + 1 if before is not None and left > 0.75 * before else 0
        if left <= MANY * n or stalled >= STALLS:
            return entries, links
        before, salt = left, F.lit(len(links))
        size = entries.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", "parts")
        placed = entries.join(size, "token").withColumn("drawn", F.pmod(F.xxhash64("cls", salt), "parts")).withColumn("x", F.struct(*entries.columns))
        order = _window(["token", "drawn"], F.xxhash64("cls", "token", salt), "cls")
        others = F.array(*(F.lead("x", k).over(order) for k in range(1, NEXT + 1)))
        met = placed.select("x", others.alias("ys")).withColumn("ys", F.expr("filter(ys, y -> y.component <> x.component)"))
        met = materialise(met.select(F.col("x.cls").alias("a"), F.size("ys").alias("differ"), F.expr(f"transform(filter(ys, y -> {fits}), y -> y.cls)").alias("fit")), "drawn")
        differ, fit = met.agg(F.sum("differ"), F.sum(F.size("fit"))).first()
        if not fit or left * fit <= MANY * n * differ:  # as many of the others may be expected to fit
            release(met)
            return entries, links
        pairs = met.select("a", F.explode("fit").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links.append(materialise(verify(pairs), "joins"))
        release(met)
        known = entries.select("cls", "component").distinct()
        of = lambda side: known.select(F.col("cls").alias(side), F.col("component").alias(f"c{side}"))  # noqa: E731, B023
        wider = components(links[-1].join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        moved = entries.join(wider.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left")
        moved = materialise(moved.select(*(F.coalesce("whole", "component").alias(c) if c == "component" else F.col(c) for c in entries.columns)), "entries")
        if entries is not given:
            release(entries)
        entries = moved


def _wider(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (id, component) with further links (a, b) between its components and classes in none: only components meet, not their classes."""
    if links.isEmpty():
        return comp
    of = lambda side: comp.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    met = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    wider = components(met)
    known = comp.union(wider.select("id", F.col("id").alias("component"))).distinct()
    found = known.join(wider.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left").select("id", F.coalesce("whole", "component").alias("component")).distinct()
    return materialise(found, "components")


def _leaders_apart() -> Column:
    """A class's leader; without one, a value of its own."""
    return F.when(F.col("lead") >= 0, F.col("lead")).otherwise(-1 - F.col("cls"))


def _further_links(entries: DataFrame, percent: int, verify: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """a, b: links of different components and leaders in the long lists. entries as in ``_further_pairs``."""
    fits = (
        f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND (100 + {percent}) * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)"
        " AND x.leader <> y.leader AND x.lead <> y.cls AND y.lead <> x.cls"
    )
    slim = entries.select("token", "block", "n", "pos", "cls", "component", "lead", _leaders_apart().alias("leader"))
    slim, links = _drawn(slim, ["component", "leader"], fits, verify)
    if links:
        known = slim.select("cls", "component").distinct()
        entries = entries.drop("component").join(known, "cls")
    more = verify(_further_pairs(entries, percent).distinct())
    return [*links, more]


def _further_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components and leaders in the long lists. entries: token, n, pos, block, cls, component, lead, short."""

    def test(c: dict, own: pa.RecordBatch, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        n, pos, comp, lead, cls = (c[k] for k in ("n", "pos", "component", "lead", "cls"))
        small, large = np.minimum(n[p], n[q]), np.maximum(n[p], n[q])
        ok = (100 * small >= percent * large) & (np.minimum(n[p] - pos[p], n[q] - pos[q]) >= needed(n[p], n[q], percent))
        # One leader answers for both, or one leads the other and is verified with it.
        ok &= (comp[p] != comp[q]) & ((lead[p] != lead[q]) | (lead[p] < 0)) & (lead[p] != cls[q]) & (lead[q] != cls[p])
        at = np.flatnonzero(ok)
        sig = own.column("short")
        for lo in range(0, len(at), 1 << 13):
            some = at[lo : lo + (1 << 13)]
            ok[some] = may_share(sig.take(pa.array(p[some])), sig.take(pa.array(q[some])), needed(n[p[some]], n[q[some]], percent))
        return ok

    rule = lambda x, y: (
        f"100 * least({x}.n_hi, {y}.n_hi) >= {percent} * greatest({x}.n_lo, {y}.n_lo) AND (100 + {percent}) * least({x}.left, {y}.left) >= {percent} * ({x}.n_lo + {y}.n_lo)"
    )
    blocks = _block_pairs(entries.withColumn("lead", F.when(F.col("lead") >= 0, F.col("lead"))), F.col("n") - F.col("pos"), ["n"], ["component", "lead"], rule)
    return _pairs_of_blocks(entries, blocks, ["n", "pos", "component", "lead", "short"], test)


def _id_hash(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64), 31)


def _sets_for(docs: DataFrame, pairs: DataFrame, classes: DataFrame, sets: Sets) -> DataFrame:
    """cls, set of the classes in the pairs, from the text of one document of each."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = materialise(classes.select("cls", "rep", "n", "s1", "s2").join(ids, "cls", "left_semi"), "wanted")

    def ids_in(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield _id_hash(b.column(0).to_numpy())

    few = wanted.count() <= FEW
    known = share(docs.sparkSession, np.unique(wanted.select("rep").toArrow().column(0).to_numpy()) if few else hash_counts(wanted.select("rep"), ids_in, MARK_BITS, marks=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy()
            b = b.filter(pa.array(_common(ids, known.value) if few else marked(known.value, _id_hash(ids), MARK_BITS), pa.bool_()))
            for lo, hi, buf, off in slices(b.column(1)):
                v, cuts = sets(buf, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(cuts)), *map(pa.array, set_hashes(v, cuts)), binary_column(v, cuts)], ["rep", "n", "s1", "s2", "set"])

    made = docs.where("doc_id IS NOT NULL").mapInArrow(run, "rep long, n long, s1 long, s2 long, set binary")
    found = made.join(wanted, ["rep", "n", "s1", "s2"]).groupBy("cls").agg(F.first("set").alias("set"))
    out = materialise(found, "pairsets")
    release(known)
    release(wanted)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of a are in sorted distinct b."""
    at = np.searchsorted(b, a)
    return (b[np.minimum(at, max(len(b) - 1, 0))] == a) if len(b) else np.zeros(len(a), bool)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """a, b, linked, na, nb, delta: exact answers; asked for, the sorted elements in one of both sets alone where a is near b.

    Members go to their leader in chunks of about CHUNK, so a leader of a third of all sets is spread over many tasks.
    """
    near = near_percent(percent)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    members = dealt.join(sets, F.col("b") == F.col("cls")).select("a", "chunk", "b", "set")
    leaders = dealt.select("a", "chunk").distinct().join(sets, F.col("a") == F.col("cls")).select("a", "chunk", F.lit(None).cast("long").alias("b"), "set")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = leaders.unionByName(members).repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))

    def answers(a: int, leader: np.ndarray, b: np.ndarray, flat: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        who, size = owner(cuts), np.diff(cuts)
        held = _common(flat, leader)
        same = np.bincount(who[held], minlength=len(b))
        linked = 100 * same >= percent * (size + len(leader) - same)
        close = np.flatnonzero(differences & (100 * same >= near * (size + len(leader) - same)))
        delta: list[bytes | None] = [None] * len(b)
        for k in close.tolist():
            own, kept = flat[cuts[k] : cuts[k + 1]], held[cuts[k] : cuts[k + 1]]
            delta[k] = np.sort(np.concatenate([own[~kept], leader[~_common(leader, own)]])).tobytes()
        full = lambda v: pa.array(np.full(len(b), v))
        return pa.RecordBatch.from_arrays([full(a), pa.array(b), pa.array(linked), full(len(leader)), pa.array(size), pa.array(delta, pa.binary())], ["a", "b", "linked", "na", "nb", "delta"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b")
            heads = np.flatnonzero(b.is_null().to_numpy(zero_copy_only=False))
            data, offsets = binaries(batch.column("set"))
            flat, cuts = np.frombuffer(data.tobytes(), dtype=np.uint64), offsets // 8
            ids = b.fill_null(0).to_numpy()
            for lo, hi in zip(np.append(0, heads + 1), np.append(heads, len(ids))):  # the members after each leader
                for k in range(lo, hi, 32):
                    m = min(k + 32, hi)
                    yield answers(int(a[k]), leader, ids[k:m], flat[cuts[k] : cuts[m]], cuts[k : m + 1] - cuts[k])
                if hi < len(ids):
                    leader = flat[cuts[hi] : cuts[hi + 1]]
        give_back()

    return both.mapInArrow(run, "a long, b long, linked boolean, na long, nb long, delta binary")


def near_percent(percent: int) -> int:
    """The likeness to a leader from which differences to it are kept."""
    return max(1, percent * 3 // 4)


def _possible_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that their signatures leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & may_share(b.column("sa"), b.column("sb"), needed(na, nb, percent))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda side: classes.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("sig").alias(f"s{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").mapInArrow(run, "a long, b long")


def _followers(answers: DataFrame) -> DataFrame:
    """lead, cls, n, nl, linked, delta: each class with the leader near to it that is most followed; leaders with themselves too."""
    near = answers.where("delta IS NOT NULL")
    counts = near.groupBy("a").agg(F.count("*").alias("followers"), F.first("na").alias("na"))
    best = near.join(counts.select("a", "followers"), "a").groupBy("b").agg(F.max_by(F.struct("a", "nb", "na", "linked", "delta"), F.struct("followers", -F.col("a"))).alias("x"))
    own = best.select(F.col("x.a").alias("lead"), F.col("b").alias("cls"), F.col("x.nb").alias("n"), F.col("x.na").alias("nl"), F.col("x.linked").alias("linked"), F.col("x.delta").alias("delta"))
    leads = counts.join(own.select(F.col("lead").alias("a")).distinct(), "a", "left_semi")
    return own.unionByName(leads.select(F.col("a").alias("lead"), F.col("a").alias("cls"), F.col("na").alias("n"), F.col("na").alias("nl"), F.lit(True).alias("linked"), F.lit(b"").alias("delta")))


def slack(a, b, percent: int):
    """By how many elements sets of sizes a and b that link may differ."""
    return a + b - 2 * needed(a, b, percent)


def _derived_links(followers: DataFrame, percent: int) -> DataFrame:
    """a, b: links of two classes of one leader, from their differences. followers: as above, with component."""
    mixed = followers.groupBy("lead").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("lead")
    some = materialise(followers.join(mixed, "lead", "left_semi"), "followers")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = binaries(b.column("delta"))
            size = np.diff(offsets) // 8
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(b.column(c).to_numpy(), size)) for c in ("lead", "cls")), pa.array(np.frombuffer(data.tobytes(), np.int64))], ["lead", "cls", "element"])

    found = materialise(some.select("lead", "cls", "delta").mapInArrow(elements, "lead long, cls long, element long"), "elements")
    common = found.groupBy("lead", "element").agg(F.count("*").alias("k")).where("k > 1")
    shared = found.join(common, ["lead", "element"]).groupBy("lead", "cls").agg(F.array_sort(F.collect_list(F.struct("k", "element"))).alias("own"))
    slim = some.withColumn("d", F.expr("length(delta) div 8")).select("lead", "cls", "n", "nl", "linked", "component", "d")
    over = F.col("d") - (F.col("n") + F.col("nl") - 2 * F.expr(f"({percent} * (n + nl) + {99 + percent}) div {100 + percent}"))
    least = F.when(F.col("linked"), 1).otherwise(F.greatest(F.lit(1), F.expr("(over + 1) div 2")))
    posted = shared.join(slim, ["lead", "cls"]).withColumn("over", over).withColumn("r", F.size("own").cast("long")).withColumn("take", F.col("r") - least + 1).where("take > 0")
    posted = posted.select("lead", "cls", "n", "component", "d", "r", F.posexplode(F.expr("slice(own, 1, cast(take as int))")).alias("pos", "e"))
    posted = posted.select(F.xxhash64("lead", "e.element").alias("token"), "d", F.col("pos").cast("long").alias("pos"), "cls", "n", "component", "r")
    place = F.row_number().over(_window("token", "d", "pos", "cls"))
    entries = materialise(posted.withColumn("block", F.xxhash64("token", F.floor((place - 1) / BLOCK))), "postings")

    def test(c: dict, own: pa.RecordBatch, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        left = np.minimum(c["r"][p] - c["pos"][p], c["r"][q] - c["pos"][q])
        return (c["component"][p] != c["component"][q]) & (2 * left >= c["d"][p] + c["d"][q] - slack(c["n"][p], c["n"][q], percent))

    rule = lambda x, y: f"2 * least({x}.left, {y}.left) >= {x}.d_lo + {y}.d_lo - (({x}.n_hi + {y}.n_hi) * {100 - percent}) div {100 + percent} - 1"

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (dx, ox), (dy, oy) = binaries(b.column("da")), binaries(b.column("db"))
            x, y = np.frombuffer(dx.tobytes(), np.uint64), np.frombuffer(dy.tobytes(), np.uint64)
            same = np.array([int(_common(x[i // 8 : j // 8], y[k // 8 : m // 8]).sum()) for i, j, k, m in zip(ox, ox[1:], oy, oy[1:])], dtype=np.int64)
            ok = np.diff(ox) // 8 + np.diff(oy) // 8 - 2 * same <= slack(b.column("na").to_numpy(), b.column("nb").to_numpy(), percent)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        of = lambda side: some.select("lead", F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("delta").alias(f"d{side}"))
        return pairs.join(of("a"), "a").join(of("b"), ["lead", "b"]).select("a", "b", "na", "nb", "da", "db").mapInArrow(decide, "a long, b long")

    # Whole numbers: 2 * left >= d + d - slack.
    fits = f"2 * least(x.r - x.pos, y.r - y.pos) >= x.d + y.d - (x.n + y.n) + 2 * (({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"
    entries, links = _drawn(entries, ["component"], fits, verify)
    blocks = _block_pairs(entries, F.col("r") - F.col("pos"), ["n", "d"], ["component"], rule)
    pairs = materialise(_pairs_of_blocks(entries, blocks, ["n", "d", "pos", "r", "component"], test).distinct(), "likely")
    return reduce(DataFrame.union, [*links, verify(pairs)])


def _window(key: str | list[str], *order: str | Column):
    from pyspark.sql.window import Window

    return Window.partitionBy(key).orderBy(*order)


def link(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return join_sets(docs, partial(sets_of, width=width), percent, id_col, text_col).withColumnRenamed("n", "n_shingles")


@tidy("joined")
def join_sets(docs: DataFrame, sets: Sets, percent: int, id_col: str = "doc_id", text_col: str = "text", by_length: bool = False) -> DataFrame:
    """doc_id, n (set size), component_id of every row; by_length deals the index lists by partitions of set sizes."""
    docs = columns_named(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    index = _index(docs, sets, percent)
    some = index.where("doc_id IS NOT NULL AND n > 0")
    grouped = some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("sig").alias("sig"), F.first("short").alias("short"))
    # Numbers that are written once and read back, so they stay.
    classes = materialise(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    slim = materialise(index.select("doc_id", "n", "s1", "s2"), "documents")
    release(index)
    some = slim.where("doc_id IS NOT NULL AND n > 0")
    # A set of fewer shingles than this links only with equal ones.
    alone = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    lists = materialise(_lists(_postings(classes.where(F.col("n") >= alone).select("cls", "n", "prefix"), percent, by_length), percent), "lists")
    entries = lists.where("b IS NULL").drop("b")
    close = _possible_pairs(_leader_pairs(entries, percent), classes, near_percent(percent))
    pairs = materialise(_possible_pairs(lists.where("b IS NOT NULL").select("a", "b").distinct(), classes, percent).union(close).distinct(), "pairs")
    held = _sets_for(docs, pairs, classes, sets)
    answers = materialise(_verify(pairs, held, percent, True), "answers")
    release(held)
    edges = answers.where("linked").select("a", "b")
    repeated = some.groupBy("doc_id").agg(*(F.min(c).alias(f"{c}_lo") for c in ("n", "s1", "s2")), *(F.max(c).alias(f"{c}_hi") for c in ("n", "s1", "s2"))).where("n_lo <> n_hi OR s1_lo <> s1_hi OR s2_lo <> s2_hi").select("doc_id")
    repeated = materialise(some.select("doc_id", "n", "s1", "s2").join(repeated, "doc_id", "left_semi").join(classes.select("n", "s1", "s2", "cls"), ["n", "s1", "s2"]).select("doc_id", "cls").distinct(), "repeated")
    edges = edges.union(repeated.join(repeated.groupBy("doc_id").agg(F.min("cls").alias("a")), "doc_id").select("a", F.col("cls").alias("b")))
    comp = components(edges)
    followers = materialise(_followers(answers).join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "leaders")
    comp = _wider(comp, materialise(_derived_links(followers, percent), "derived"))
    lead = followers.where("lead <> cls").select("cls", "lead")
    known = entries.withColumnRenamed("a", "cls").join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = known.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    known = known.join(mixed, "token", "left_semi").join(lead, "cls", "left").withColumn("lead", F.coalesce("lead", F.lit(-1)))
    known = materialise(known.join(classes.select("cls", "short"), "cls").drop("part"), "entries")
    release(lists)
    unordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verified(found: DataFrame) -> DataFrame:
        new = materialise(_possible_pairs(found.join(unordered, ["a", "b"], "left_anti"), classes, percent), "further")
        if new.isEmpty():
            return new
        return materialise(_verify(new, _sets_for(docs, new, classes, sets), percent).where("linked").select("a", "b"), "links")

    comp = _wider(comp, reduce(DataFrame.union, _further_links(known, percent, verified)))
    # The smallest document of each component; classes alone keep their own.
    least = comp.join(classes.select(F.col("cls").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    in_some = comp.join(least, "component").select(F.col("id").alias("cls"), "component_id")
    found = classes.select("n", "s1", "s2", "rep", "cls").join(in_some, "cls", "left").select("n", "s1", "s2", F.coalesce("component_id", "rep").alias("component_id"))
    # Few columns: equal sets are joined back by their hashes.
    every = slim.join(found, ["n", "s1", "s2"], "left")
    return every.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
