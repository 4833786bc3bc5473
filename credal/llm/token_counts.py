"""Token counts that follow edits without encoding whole texts again.

A document is kept as a segment tree over its pre-tokens: a leaf holds ``LEAF`` consecutive units (see tokens.Encoder),
with its code points and its tokens, and every inner node the sums of its children. An edit (position, code points to
delete, text to insert) finds its leaves by descending the sums, joins their text with one leaf of context on both sides,
further ones while an edge would not be an edge of a unit, encodes that region alone, puts it in the region's first leaf and
updates the sums on the paths up. A leaf that grows beyond ``GROWN`` code points makes its document's tree anew.

Null text is empty (no tokens). Edits are applied in the order given, each to the text the one before left; positions and
lengths beyond the text are cut to it, negative or null ones count as 0, null insertions as empty. Null ids and repeated
rows are kept. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import per_text, slices
from .tokens import Encoder, encoder

LEAF, GROWN = 32, 4096
#: White space, as the splitting of byte-level files sees it: runs of it are not cut.
_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}


class SegmentTree:
    """Sums of code points and tokens over leaves."""

    __slots__ = ("size", "chars", "tokens")

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, (len(chars) - 1).bit_length())
        self.chars = [0] * self.size + chars + [0] * (self.size - len(chars))
        self.tokens = [0] * self.size + tokens + [0] * (self.size - len(tokens))
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a code point and the code points before the leaf."""
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if position >= before + self.chars[at] and self.chars[at + 1]:
                before += self.chars[at]
                at += 1
        return at - self.size, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        at = leaf + self.size
        more, extra = chars - self.chars[at], tokens - self.tokens[at]
        while at:
            self.chars[at] += more
            self.tokens[at] += extra
            at //= 2


class CountedText:
    """A text with its tree; ``changed`` holds the leaves' texts that are no longer slices of the first text."""

    __slots__ = ("text", "starts", "tree", "changed")

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.text, self.changed = text, {}
        self.starts = [0]
        for c in chars:
            self.starts.append(self.starts[-1] + c)
        self.tree = SegmentTree(chars, tokens)

    @property
    def n_chars(self) -> int:
        return self.tree.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tree.tokens[1]

    def leaf(self, k: int) -> str:
        return self.changed[k] if k in self.changed else self.text[self.starts[k] : self.starts[k + 1]]

    def whole(self) -> str:
        return "".join(self.leaf(k) for k in range(len(self.starts) - 1))

    def region(self, position: int, delete: int, insert: str) -> tuple[int, int, str]:
        """First and last leaf to encode again, and their new text."""
        position = max(0, min(position, self.n_chars))
        delete = max(0, min(delete, self.n_chars - position))
        lo, before = self.tree.find(position)
        hi = self.tree.find(position + delete)[0]
        last = len(self.starts) - 2
        text = "".join(self.leaf(k) for k in range(lo, hi + 1))
        at = position - before
        text = text[:at] + insert + text[at + delete :]
        context = False
        while lo and not context:  # the leaf before keeps its beginning, which is an edge of units
            lo -= 1
            more = self.leaf(lo)
            text, context = more + text, bool(more)
        context = False
        while hi < last and not (context and text and text[-1] not in _SPACES):
            hi += 1
            more = self.leaf(hi)
            text, context = text + more, context or bool(more)
        return lo, hi, text

    def put(self, lo: int, hi: int, text: str, tokens: int) -> None:
        for k in range(lo, hi + 1):
            self.changed[k] = text if k == lo else ""
            self.tree.put(k, len(text) if k == lo else 0, tokens if k == lo else 0)


def build(enc: Encoder, texts: list[str]) -> list[CountedText]:
    """Trees of texts, their units encoded together."""
    out: list[CountedText] = []
    for lo, hi, buf, off in slices(pa.array(texts, pa.large_string())):
        start, end = enc.units(buf, off)
        rows = enc.unit_rows(buf, start, end)
        counts = enc.length[rows]
        cuts = per_text(start, off)
        # A leaf begins at every LEAF-th unit of its text; it reaches to the next leaf or the text's end.
        within = np.arange(len(start)) - np.repeat(cuts[:-1], np.diff(cuts))
        heads = np.flatnonzero(within % LEAF == 0)
        tokens = np.add.reduceat(counts, heads) if len(heads) else np.zeros(0, np.int64)
        leaf_cuts = np.searchsorted(heads, cuts)
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        head_points = points[start[heads]] if len(heads) else np.zeros(0, np.int64)
        ends = points[off[1:]]
        for i in range(hi - lo):
            a, b = leaf_cuts[i], leaf_cuts[i + 1]
            text = texts[lo + i]
            if a == b:
                out.append(CountedText(text, [len(text)], [0]))
            else:
                edges = np.append(head_points[a:b], ends[i])
                edges[0] = points[off[i]]
                out.append(CountedText(text, np.diff(edges).tolist(), tokens[a:b].tolist()))
    return out


def edit(enc: Encoder, texts: list[CountedText], edits: list[tuple[int, int, str]]) -> list[int]:
    """Applies one edit to each text, all regions encoded together; returns the code points encoded for each."""
    whole = [t.region(*e) for t, e in zip(texts, edits)]
    counts: list[int] = []
    for _, _, buf, off in slices(pa.array([w[2] for w in whole], pa.large_string())):
        counts += enc.counts(buf, off).tolist()
    for k, (t, (lo, hi, text)) in enumerate(zip(texts, whole)):
        t.put(lo, hi, text, counts[k])
        if len(text) > GROWN:
            texts[k] = build(enc, [t.whole()])[0]
    return [len(w[2]) for w in whole]


def count_edited(docs: DataFrame, tokenizer_path: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_edits, edited_tokens, edited_chars, encoded_chars, edited_text of every document.

    edits: array of struct(position, delete, insert), in order; null for none. Byte-level tokenizer files only: others are an error.
    """
    names = ["doc_id", "n_tokens", "n_edits", "edited_tokens", "edited_chars", "encoded_chars", "edited_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, True)
        if not enc.cuts:
            raise ValueError(f"{tokenizer_path} is no file whose texts can be cut into units")
        for batch in batches:
            every, edits, ids = batch.column(1).fill_null("").to_pylist(), batch.column(2).to_pylist(), batch.column(0)
            lo = 0
            while lo < len(every):
                hi, size = lo, 0
                while hi < len(every) and (hi == lo or size < 1 << 21):
                    size += len(every[hi])
                    hi += 1
                yield _count(enc, ids.slice(lo, hi - lo), every[lo:hi], edits[lo:hi], names)
                lo = hi

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       F.expr(f"transform(`{edits_col}`, e -> struct(cast(e.position as long) as position, cast(e.delete as long) as delete, cast(e.insert as string) as insert))").alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, edited_tokens long, edited_chars long, encoded_chars long, edited_text string")


def _count(enc: Encoder, ids: pa.Array, texts: list[str], edits: list, names: list[str]) -> pa.RecordBatch:
    trees = build(enc, texts)
    before = [t.n_tokens for t in trees]
    plans = [[(max(0, e["position"] or 0), max(0, e["delete"] or 0), e["insert"] or "") for e in (x or []) if e is not None] for x in edits]
    encoded = [0] * len(trees)
    for step in range(max(map(len, plans), default=0)):
        rows = [i for i, p in enumerate(plans) if len(p) > step]
        some = [trees[i] for i in rows]
        for i, n in zip(rows, edit(enc, some, [plans[i][step] for i in rows])):
            encoded[i] += n
        for i, t in zip(rows, some):
            trees[i] = t
    columns = [before, [len(p) for p in plans], [t.n_tokens for t in trees], [t.n_chars for t in trees], encoded]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns), pa.array([t.whole() for t in trees], pa.string())], names)
