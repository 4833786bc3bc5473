"""Line dedup by a log-template tree.

Lines (between newlines) are parsed by a tree of fixed depth: token count, then the leading ``depth`` tokens, then the leaf's
templates. A token with a digit is a variable field. Within a leaf a line joins the template that agrees with it in the
largest share of positions, ``similarity`` at least (wildcards agree with all), and positions that differ become wildcards;
else it begins a template. A line of up to ``FIELDS`` words that are all variable fields is no template: its words stand for
themselves. A leaf's lines are dealt by hash into ``PARTS`` parts, each parsed by itself, and then the parts' templates are parsed
in the same way, so a leaf that a third of all lines reach is spread over tasks. Lines (templates) enter in order of how many
documents have them, so results don't depend on how rows are dealt.

One rule says what recurs, for lines of any length: a template whose repeats hold ``repeated_words`` words at least, counted as
(documents that have it - 1) * words. Its lines stay in the first of these documents (smallest id; ``keep_first`` false: in none)
and are dropped from the others. The same rule holds for runs of lines: one of as many words that two documents share is
dropped from the second one, from the first to the last line that only these two have, wherever the line breaks are;
empty lines don't end a run.

Lines are counted first, by 64-bit hashes; only leaves that several documents reach are parsed, found by exact counts. Counts
are aggregated before they are shuffled, and drops go back to their documents as line numbers, which built-in functions then
cut out. Words are compared by 32 bits of their hashes: two different words in one place of one leaf pass for the same once
in four billion cases.

Null text stays null and has no lines; empty texts stay; a document all of whose lines are dropped keeps an empty text. Rows
that repeat id and text count as one document. A null id is an id like others, before all. Ties in the number of documents go
by hash. Further columns are kept as they are, whatever their names (n_chars, where there is one, is set to the new length;
a column named like one that is added gives way). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER_CODE, binary_column, mix, owner, per_text, prefix_hash, ragged, slices, span_hash, words
from .runtime import hash_counts, marked, materialise, release, share, tidy

MARK_BITS, FIELDS, PARTS = 26, 4, 16
#: The columns that ``dedup`` adds.
ADDED = ("dropped_lines", "first_lines")
_NEWLINE, _DIGIT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_DIGIT[48:58] = True
_BASE, _MASK = 0xD6E8FEB86659FD93, (1 << 64) - 1


def parse_lines(buf: np.ndarray, offsets: np.ndarray, depth: int):
    """Of the lines with words: text, line number, leaf hash, line hash, word count; and the words' hashes and line offsets."""
    start, end = words(buf, offsets)
    h = span_hash(prefix_hash(buf, LOWER_CODE), start, end)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    plain, variable = h.copy(), digits[end] > digits[start]
    h[variable] = np.uint64(0)
    l_start, l_end = words(buf, offsets, _NEWLINE)
    cuts = np.append(np.searchsorted(start, l_start), len(start))
    count = np.diff(cuts)
    text = owner(per_text(l_start, offsets))
    breaks = np.concatenate([[0], np.cumsum(_NEWLINE[buf])])
    number = breaks[l_start] - breaks[offsets[:-1]][text]
    keep = np.flatnonzero(count > 0)
    first, count, text, number = cuts[:-1][keep], count[keep], text[keep], number[keep]
    fixed = np.concatenate([[0], np.cumsum(~variable)])
    bare = np.flatnonzero((count <= FIELDS) & (fixed[first + count] == fixed[first]))
    own = ragged(first[bare], count[bare])
    h[own] = plain[own]
    leaf = mix(count.astype(np.uint64), 5)
    for k in range(depth):
        some = count > k
        leaf[some] = mix(leaf[some] * np.uint64(0x2545F4914F6CDD1D) + h[first[some] + k], k + 1)
    # A line's hash: words weighted by position, then mixed with the count.
    at = ragged(first, count)
    place = at - np.repeat(first, count)
    weight = mix(np.arange(int(count.max()) if len(count) else 0, dtype=np.uint64), 77)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h[at], 3) * weight[place], dtype=np.uint64)])
    edge = np.concatenate([[0], np.cumsum(count)])
    line = mix(sums[edge[1:]] - sums[edge[:-1]] + count.astype(np.uint64), 9)
    return text, number, leaf, line, count, h, first


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """uid, doc_id, number, place (among these lines), leaf, line, n_words of every line with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, doc = batch.column(0), batch.column(1)
            for lo, hi, buf, off in slices(batch.column(2)):
                text, number, leaf, line, count, _, _ = parse_lines(buf, off, depth)
                at = pa.array(text + lo)
                place = np.arange(len(text)) - np.searchsorted(text, text)
                yield pa.RecordBatch.from_arrays(
                    [uid.take(at), doc.take(at), pa.array(number.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(leaf.view(np.int64)), pa.array(line.view(np.int64)), pa.array(count.astype(np.int32))],
                    ["uid", "doc_id", "number", "place", "leaf", "line", "n_words"],
                )

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, number int, place int, leaf long, line long, n_words int")


def _line_words(docs: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """leaf, line, words (unsigned 32 bits each) of the lines in the leaves (and in few others, by the marks' collisions)."""

    def leaf_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield b.column(0).to_numpy().view(np.uint64)

    marks = share(docs.sparkSession, hash_counts(leaves.select("leaf"), leaf_hashes, MARK_BITS, marks=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in slices(batch.column(0)):
                _, _, leaf, line, count, h, first = parse_lines(buf, off, depth)
                hit = np.flatnonzero(marked(marks.value, leaf, MARK_BITS))
                hit = hit[np.unique(line[hit], return_index=True)[1]]
                flat = (h[ragged(first[hit], count[hit])] >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[hit].view(np.int64)), pa.array(line[hit].view(np.int64)), binary_column(flat, np.concatenate([[0], np.cumsum(count[hit])]))],
                    ["leaf", "line", "words"],
                )

    return docs.select("text").mapInArrow(run, "leaf long, line long, words binary")


class Leaf:
    """The templates of a leaf: rows of words, and which positions are wildcards."""

    def __init__(self, size: int, similarity: float):
        self.rows, self.wild = np.zeros((4, size), np.uint32), np.zeros((4, size), bool)
        self.names: list[int] = []
        self.docs: list[int] = []
        self.similarity = similarity

    def place(self, line: int, own: np.ndarray, wild: np.ndarray | None = None, docs: int = 0) -> int:
        """The template of a line (or of a template with wildcards), by the hash of the line that began it."""
        n = len(self.names)
        if n:
            fits = (self.rows[:n] == own) | self.wild[:n]
            if wild is not None:
                fits |= wild
            share = fits.mean(axis=1)
            best = int(share.argmax())
            if share[best] >= self.similarity:
                self.wild[best] |= ~fits[best] if wild is None else ~fits[best] | wild
                self.docs[best] += docs
                return self.names[best]
            if n == len(self.rows):
                self.rows, self.wild = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.wild))
        self.rows[n] = own
        if wild is not None:
            self.wild[n] = wild
        self.names.append(line)
        self.docs.append(docs)
        return line


def _templates(lines: DataFrame, similarity: float) -> DataFrame:
    """leaf, line, template of the lines whose template another line began. lines: leaf, line, docs, words."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["leaf", "line", "template", "docs", "words", "wild"]
    schema = "leaf long, line long, template long, docs long, words binary, wild binary"

    def parsed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
        """Rows without words: a line and its template. Rows with: a template of the group that the first ``keys`` columns name."""
        now, leaf, out = None, None, []

        def ended() -> list[tuple]:
            return [(now[0], t, t, d, r.tobytes(), np.packbits(w).tobytes()) for t, d, r, w in zip(leaf.names, leaf.docs, leaf.rows, leaf.wild)] if leaf else []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), pa.schema([(n, pa.binary() if n in ("words", "wild") else pa.int64()) for n in names]))], names)

        for b in batches:
            wilds = b.column("wild") if "wild" in b.schema.names else None
            for k, (line, docs, *key) in enumerate(zip(*(b.column(c).to_pylist() for c in ["line", "docs", "leaf", "part"][: 2 + keys]))):
                own = np.frombuffer(b.column("words")[k].as_py(), dtype=np.uint32)
                if key != now:
                    out += ended()
                    now, leaf = key, Leaf(len(own), similarity)
                wild = np.unpackbits(np.frombuffer(wilds[k].as_py(), np.uint8), count=len(own)).astype(bool) if wilds is not None else None
                template = leaf.place(line, own, wild, docs)
                if template != line:
                    out.append((key[0], line, template, None, None, None))
                if len(out) >= 2000:
                    yield batch()
                    out.clear()
        out += ended()
        if out:
            yield batch()

    dealt = lines.withColumn("part", F.pmod("line", F.lit(PARTS)))
    first = dealt.repartition(parts, "leaf", "part").sortWithinPartitions("leaf", "part", F.desc("docs"), "line").mapInArrow(lambda x: parsed(x, 2), schema)
    first = materialise(first, "parts")
    again = first.where("words IS NOT NULL").select("leaf", "line", "docs", "words", "wild").repartition(parts, "leaf").sortWithinPartitions("leaf", F.desc("docs"), "line")
    second = materialise(again.mapInArrow(lambda x: parsed(x, 1), schema).where("words IS NULL").select("leaf", "line", "template"), "merged")
    own = first.where("words IS NULL").select("leaf", "line", "template")
    moved = own.join(second.select("leaf", F.col("line").alias("template"), F.col("template").alias("final")), ["leaf", "template"], "left").select("leaf", "line", F.coalesce("final", "template").alias("template"))
    return moved.union(second)


class Runs:
    """All runs of a sequence: the suffix automaton of its parts."""

    def __init__(self):
        self.step, self.up, self.size = [{}], [-1], [0]
        self.last = 0

    def part(self) -> None:
        """No run reaches from what was added into what will be."""
        self.last = 0

    def add(self, key: int) -> None:
        p = self.last
        q = self.step[p].get(key)
        if q is not None and self.size[q] == self.size[p] + 1:
            self.last = q
            return
        cur = q if q is not None else self._state({}, 0, self.size[p] + 1)
        if q is None:
            while p >= 0 and key not in self.step[p]:
                self.step[p][key] = cur
                p = self.up[p]
            if p < 0:
                self.last = cur
                return
            q = self.step[p][key]
            if self.size[q] == self.size[p] + 1:
                self.up[cur], self.last = q, cur
                return
        copy = self._state(dict(self.step[q]), self.up[q], self.size[p] + 1)
        self.up[q] = copy
        self.last = copy if cur == q else cur
        if cur != q:
            self.up[cur] = copy
        while p >= 0 and self.step[p].get(key) == q:
            self.step[p][key] = copy
            p = self.up[p]

    def _state(self, step: dict, up: int, size: int) -> int:
        self.step.append(step)
        self.up.append(up)
        self.size.append(size)
        return len(self.step) - 1

    def follow(self, state: int, size: int, key: int) -> tuple[int, int]:
        """The longest run at the end of what was followed so far: its state and its size."""
        while state and key not in self.step[state]:
            state = self.up[state]
            size = self.size[state]
        return (self.step[state][key], size + 1) if key in self.step[state] else (0, 0)


def shared_runs(one: list[tuple], other: list[tuple], long_words: int) -> set[int]:
    """The places in other of runs of long_words or more that one has too. Both: place, key, words, by place."""
    runs, before = Runs(), None
    for place, key, _ in one:
        if before is None or place != before + 1:
            runs.part()
        runs.add(key)
        before = place
    found: set[int] = set()
    upto = np.concatenate([[0], np.cumsum([w for _, _, w in other])])
    state, size, before, done = 0, 0, None, 0
    for i, (place, key, _) in enumerate(other):
        state, size = runs.follow(*((state, size) if before is not None and place == before + 1 else (0, 0)), key)
        if upto[i + 1] - upto[i + 1 - size] >= long_words:
            found.update(p for p, _, _ in other[max(done, i + 1 - size) : i + 1])
            done = i + 1
        before = place
    return found


def between_own(rows: list[tuple], found: set[int]) -> list[int]:
    """The numbers of the found places, without lines of more documents at either end of a stretch. Rows: place, number, own."""
    out: list[int] = []
    held: list[int] = []
    before = None
    for place, number, own in rows:
        if place not in found:
            before = None
            continue
        if before is None or place != before + 1:
            held, inside = [], False
        before = place
        if own:
            out += [*(held if inside else []), number]
            held, inside = [], True
        else:
            held.append(number)
    return out


def pair_segments(lines: list[dict], long_words: int) -> Iterator[tuple[tuple[int, int], list[dict]]]:
    """The stretches of a document's lines (by place) that a pair of documents may share: lines of this pair or of more documents."""
    pair, lo, after = None, 0, 0  # the stretch's pair and first line; the line after the pair's last one
    for i, x in enumerate([*lines, None]):
        broken = x is None or (i > 0 and x["place"] != lines[i - 1]["place"] + 1)
        own = (x["home"], x["other"]) if x is not None and x["home"] is not None else None
        if broken or (own is not None and own != pair):
            if pair is not None and sum(y["words"] for y in lines[lo:i]) >= long_words:
                yield pair, lines[lo:i]
            if broken:
                pair, lo = None, i
            elif pair is not None:
                lo = after
        if own is not None:
            pair, after = own, i + 1


def _run_drops(by_doc: DataFrame, counts: DataFrame, long_words: int) -> DataFrame:
    """uid, numbers: lines of the second of two documents in runs that both have."""
    two = F.col("docs") == 2
    known = counts.where("docs > 1").select("leaf", "template", F.when(two, F.col("home.uid")).alias("home"), F.when(two, F.col("away.uid")).alias("other"))
    shared = by_doc.join(known, ["leaf", "template"]).select("uid", "n_words", F.xxhash64("leaf", "template").alias("key"), "home", "other", F.explode("at").alias("at"))
    line = F.struct("at.place", "at.number", "key", F.col("n_words").alias("words"), "home", "other")
    texts = shared.groupBy("uid").agg(F.array_sort(F.collect_set(line)).alias("lines"), F.count("home").alias("pairs")).where("pairs > 0").select("uid", "lines")
    names = ["home", "other", "uid", "place", "number", "key", "words", "own"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(*pair, uid, x["place"], x["number"], x["key"], x["words"], x["home"] is not None) for uid, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for pair, some in pair_segments(lines, long_words) for x in some]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64(), pa.int32(), pa.bool_()])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names)))
        for (home, other), group in groupby(rows, lambda r: r[:2]):
            sides: dict[int, list[tuple]] = {home: [], other: []}
            for r in group:
                sides[r[2]].append(r[3:])
            found = shared_runs([(p, k, w) for p, _, k, w, _ in sides[home]], [(p, k, w) for p, _, k, w, _ in sides[other]], long_words)
            found = between_own([(p, n, own) for p, n, _, _, own in sides[other]], found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([other], pa.int64()), pa.array([found], pa.list_(pa.int32()))], ["uid", "numbers"])

    parts = int(by_doc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = texts.mapInArrow(segments, "home long, other long, uid long, place int, number int, key long, words int, own boolean")
    return made.repartition(parts, "home", "other").sortWithinPartitions("home", "other", "uid", "place").mapInArrow(run, "uid long, numbers array<int>")


@tidy("drops")
def find_drops(docs: DataFrame, depth: int = 4, similarity: float = 0.8, repeated_words: int = 12, keep_first: bool = True) -> DataFrame:
    """uid, numbers, firsts: the numbers of each document's lines to drop, and of recurring ones it keeps. docs: uid, doc_id, text."""
    lines = materialise(_lines(docs, depth), "lines")
    known = materialise(lines.groupBy("leaf", "line", "uid").agg(F.first("n_words").alias("n_words")).groupBy("leaf", "line").agg(F.count("*").alias("docs")), "known")
    # A line recurs itself, or may share a template; what is alone in its leaf and in one document does neither.
    leaves = known.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("docs").alias("docs")).where("docs > 1")
    leaves = materialise(leaves, "leaves")
    several = known.join(leaves.where("n > 1").select("leaf"), "leaf", "left_semi")
    text = _line_words(docs, leaves.where("n > 1").select("leaf"), depth).groupBy("leaf", "line").agg(F.first("words").alias("words"))
    moved = materialise(_templates(several.join(text, ["leaf", "line"]), similarity), "templates")
    some = known.join(leaves.select("leaf"), "leaf", "left_semi").join(moved, ["leaf", "line"], "left").select("leaf", "line", F.coalesce("template", "line").alias("template"), "docs")
    # Templates of one document have nothing to drop.
    again = some.groupBy("leaf", "template").agg(F.sum("docs").alias("docs")).where("docs > 1").select("leaf", "template")
    some = some.join(again, ["leaf", "template"], "left_semi").select("leaf", "line", "template")
    named = lines.join(some, ["leaf", "line"]).select("uid", "doc_id", "number", "place", "n_words", "leaf", "template")
    by_doc = named.groupBy("leaf", "template", "uid").agg(F.min("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list(F.struct("number", "place")).alias("at"))
    by_doc = materialise(by_doc, "occurrences")
    release(lines)
    place = F.struct("doc_id", "uid")
    counts = by_doc.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.first("n_words").alias("n_words"), F.min(place).alias("home"), F.max(place).alias("away"))
    recurs = counts.where((F.col("docs") - 1) * F.col("n_words") >= repeated_words).select("leaf", "template", F.col("home.uid").alias("home"))
    stays = (F.col("uid") == F.col("home")) & F.lit(keep_first)
    drops = by_doc.join(recurs, ["leaf", "template"]).select("uid", F.col("at.number").alias("numbers"), stays.alias("first"))
    drops = drops.unionByName(_run_drops(by_doc, counts, repeated_words).withColumn("first", F.lit(False)))
    every = lambda first: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("first") == first, F.col("numbers")))))
    drops = drops.groupBy("uid").agg(F.array_sort(every(False)).alias("numbers"), every(True).alias("firsts"))
    # A line kept as a template's first may lie in a run that an earlier document has.
    drops = drops.withColumn("firsts", F.array_sort(F.array_except("firsts", "numbers")))
    return drops


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The columns of docs with recurring lines cut out of the text; ``dropped_lines``, the numbers of these lines, and
    ``first_lines``, those of recurring lines that stay because no earlier document has them."""
    names = [c for c in docs.columns if c not in ADDED]
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    uid = F.xxhash64(ident, F.coalesce(text, F.lit("")))
    drops = find_drops(docs.select(uid.alias("uid"), ident.alias("doc_id"), text.alias("text")), **rules)
    # Lines travel in place of the text, so that the cut below finds each by its number without splitting again.
    others = [c for c in names if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0)).alias("row"), uid.alias("uid"), F.split(text, "\n").alias("lines"))
    both = rows.join(drops.select("uid", "numbers", "firsts").hint("shuffle_hash"), "uid", "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("numbers"))  # by hash, so linear
    cut = F.when(F.size(F.coalesce("numbers", F.array().cast("array<int>"))) == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    out = both.withColumn("cut", cut)
    none = F.array().cast("array<int>")

    def column(c: str):
        if c == text_col:
            return F.col("cut").alias(c)
        if c == "n_chars":
            return F.when(F.size("numbers") > 0, F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias(c)
        return F.col(f"row.`{c}`")

    return out.select(*map(column, names), F.coalesce("numbers", none).alias("dropped_lines"), F.coalesce("firsts", none).alias("first_lines"))
