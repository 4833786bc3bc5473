"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Words are maximal runs without ASCII white space, lower-cased in A-Z, with ASCII punctuation at both ends left out of
account. Every anchor word starts a signature of itself and the next ``chain`` content words (words that are no anchors);
an anchor with fewer after it has none. A text with words but without a signature gets one for its whole word sequence,
so short texts and texts of unknown languages are told apart; a text without words has no signature. The fingerprint is
the base64 form of the sorted distinct signatures, 32 bits each: equal texts have equal fingerprints, and a fingerprint
holds all that a comparison needs.

Likeness is the Jaccard similarity of the signature sets; two empty sets are alike (1), an empty and another are not (0).
Comparison is pruned by set length first: sets whose lengths alone rule the threshold out are never intersected. ``link``
joins all documents: each set posts its rarest signatures in the lists of its length partition and of the next one, whose
sets are the only larger ones it can link with; lists are pruned by length, position and bucket counts before sets are
intersected, and a list of near copies is never expanded into all its pairs (the index lists of ``ngram_join`` do that).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER_CODE, SPACE, distinct_sorted, mix, per_text, prefix_hash, slices, span_hash, words
from .ngram_join import join_sets
from .runtime import columns_named

#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be been but by can did do for from had has have he her his i if in is it its not of on or said "
    "she so than that the their then there these they this to was we were which will with would you "
    "als am auch auf aus bei das dem den der des die ein eine einem einen einer es für hat ich im ist mit nicht sich sie "
    "sind und uns von war wie zu zum zur über "
    "au aux avec ce ces dans de du elle en est et il ils je la le les leur mais ne nous ou où par pas pour qu que qui sa "
    "se ses son sont sur un une vous à "
    "al como con del el era ese esta este fue ha la las lo los más me mi no o para pero por se sin su sus tu un una y ya "
    "está muy"
)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BREAK = SPACE | _PUNCTUATION


def _anchor_table(anchors: tuple[str, ...]) -> np.ndarray:
    """Sorted hashes of the anchor words."""
    raw = [a.encode() for a in anchors]
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    return np.unique(span_hash(prefix_hash(buf, LOWER_CODE), ends - [len(r) for r in raw], ends))


def signatures(buf: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct 32-bit signatures, and the offsets by text."""
    n_texts = len(offsets) - 1
    start, end = words(buf, offsets)
    if len(start):  # trim punctuation; words of punctuation alone stay as they are
        solid = ~_BREAK[buf]
        upto = np.concatenate([[0], np.cumsum(solid)])
        has = upto[end] > upto[start]
        at = np.flatnonzero(solid)
        start = np.where(has, at[np.minimum(upto[start], max(len(at) - 1, 0))] if len(at) else start, start)
        end = np.where(has, (at[np.maximum(upto[end] - 1, 0)] + 1) if len(at) else end, end)
    cuts = per_text(start, offsets)
    h = span_hash(prefix_hash(buf, LOWER_CODE), start, end)
    near = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
    anchor = anchors[near] == h if len(anchors) else np.zeros(len(h), bool)
    content = np.flatnonzero(~anchor)
    # Of each anchor: its place among the content words, and the end of its text's content words.
    before = np.concatenate([[0], np.cumsum(~anchor)])
    spots = np.flatnonzero(anchor)
    text = np.repeat(np.arange(n_texts), np.diff(cuts))[spots]
    first, last = before[spots], before[cuts[1:]][text]
    keep = first + chain <= last
    spots, first, text = spots[keep], first[keep], text[keep]
    sig = h[spots]
    for k in range(chain):
        sig = mix(sig * np.uint64(0x2545F4914F6CDD1D) + h[content[first + k]], k + 1)
    bare = np.flatnonzero((np.bincount(text, minlength=n_texts) == 0) & (np.diff(cuts) > 0))
    if len(bare):
        whole = np.array([np.bitwise_xor.reduce(mix(h[cuts[i] : cuts[i + 1]] + np.arange(cuts[i + 1] - cuts[i], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 11)) for i in bare], dtype=np.uint64)
        order = np.argsort(np.concatenate([text, bare]), kind="stable")
        sig, text = np.concatenate([sig, whole])[order], np.concatenate([text, bare])[order]
    by_text = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_texts))]).astype(np.int64)
    return distinct_sorted((sig >> np.uint64(32)).astype(np.uint32), by_text)


def fingerprint(values: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(values, dtype="<u4").tobytes()).decode()


def values_of(text: str) -> np.ndarray:
    """A fingerprint's signatures."""
    return np.frombuffer(base64.b64decode(text), dtype="<u4")


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of sorted distinct arrays; 0 at once where the lengths alone keep it under the threshold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(a) + len(b) - same)


def fingerprint_texts(texts: pa.Array, chain: int = 2, anchors: str = ANCHORS) -> list[np.ndarray]:
    """The signatures of each text."""
    table, out = _anchor_table(tuple(anchors.split())), []
    for _, _, buf, off in slices(texts):
        values, cuts = signatures(buf, off, table, chain)
        out += [values[cuts[i] : cuts[i + 1]] for i in range(len(cuts) - 1)]
    return out


def fingerprints(docs: DataFrame, chain: int = 2, anchors: str = ANCHORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_signatures of every whole text; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = fingerprint_texts(batch.column(1), chain, anchors)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([fingerprint(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "fingerprint", "n_signatures"])

    return columns_named(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string, n_signatures long")


def _joined_sets(buf: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures as evenly spread 64-bit hashes, ascending by text."""
    values, cuts = signatures(buf, offsets, anchors, chain)
    return distinct_sorted(mix(values.astype(np.uint64), 71), cuts)


def link(docs: DataFrame, percent: int = 80, chain: int = 2, anchors: str = ANCHORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_signatures, component_id of every row: the smallest id reachable by links of likeness percent / 100 or more.

    A text without signatures links with nothing, null text is empty; null and repeated ids as in ``ngram_join``.
    """
    sets = partial(_joined_sets, anchors=_anchor_table(tuple(anchors.split())), chain=chain)
    return join_sets(docs, sets, percent, id_col, text_col, by_length=True).withColumnRenamed("n", "n_signatures")
