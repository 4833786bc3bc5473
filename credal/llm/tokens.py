"""Exact, cached encoding of whole texts with the tokenizers library, as ``encode(text, add_special_tokens=False)`` gives it.

A pre-tokeniser never joins text over the edges used here, so a text's ids are the ids of its units one after the other:
``spaced`` units (a white-space run with the solid run after it, for byte-level BPE) or ``bare`` units (solid runs; white
space is dropped). Distinct units are encoded once a worker and looked up by hash afterwards: plain ones piece by piece by the
library's model, those with a control string (an added token of the file) or with characters beyond Latin-1 letters by the library whole.
What a file says of its normaliser, splitting and added tokens is compared with what this relies on when it is opened; texts
of any other file are encoded by the library as a whole.
"""

from __future__ import annotations

import gc
import itertools
import json
import re

import numpy as np

from .arrays import SPACE, flags_at, per_text, prefix_hash, ragged, span_hash, words

_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Texts of these characters alone are split here, as the files' own patterns split them; others go to the library whole.
_PLAIN = re.compile(r"[\x00-\x7f\u00c0-\u00ff]*")
_SPACED_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\t-\r {_LETTER}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_BARE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\t-\r {_LETTER}0-9]+")
#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_own = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _own} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(_own))}
_TO_ALPHABET = {c: "".join(_ALPHABET[b] for b in chr(c).encode()) for c in range(256)}
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: What the two kinds of files have to say of themselves for their texts to be cut into units.
_NO_OPTIONS = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_SPACED_FILE = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "post_processor": None,
    "model": {"type": "BPE", "end_of_word_suffix": None, **_NO_OPTIONS},
}
_BARE_FILE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "model": {"type": "BPE", "end_of_word_suffix": "</w>", **_NO_OPTIONS},
}
#: Units kept by a worker, spaced and bare; beyond it the cache starts anew, which costs time, never results.
CACHE_UNITS = {True: 1_200_000, False: 780_000}
#: Pieces of units kept beside them.
CACHE_PIECES = 60_000
_open: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, spaced: bool) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    if (path, spaced) not in _open:
        _open[path, spaced] = Encoder(path, spaced)
    return _open[path, spaced]


class HashIndex:
    """64-bit keys to rows: linear probing over arrays, for whole arrays of keys at a time."""

    def __init__(self, bits: int = 16):
        self.bits = bits
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.rows = np.full(1 << bits, -1, dtype=np.int32)
        self.n = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rows of the keys, -1 for unknown ones."""
        slot = self._slot(keys)
        out = self.rows[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.keys) - 1)
            row = self.rows[slot]
            out[todo] = row
            more = (row >= 0) & (self.keys[slot] != keys[todo])
            todo, slot = todo[more], slot[more]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct new keys get the next rows."""
        rows = np.arange(self.n, self.n + len(keys))
        self.n += len(keys)
        if 4 * self.n > 3 * len(self.keys):
            old = self.rows >= 0
            keys, rows = np.concatenate([self.keys[old], keys]), np.concatenate([self.rows[old], rows])
            while 4 * self.n > 3 << self.bits:
                self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.rows[slot] < 0
            at = slot[free]
            self.rows[at], self.keys[at] = rows[free], keys[free]  # of several for one slot, one stays
            left = self.rows[slot] != rows
            keys, rows, slot = keys[left], rows[left], (slot[left] + 1) & (len(self.keys) - 1)


class Encoder:
    def __init__(self, path: str, spaced: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaced = spaced
        said = json.loads(self.tokenizer.to_str())
        added = said["added_tokens"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in added)
        found = {k: v if k != "model" else {m: x for m, x in v.items() if m not in ("vocab", "merges")} for k, v in said.items() if k in _BARE_FILE}
        #: Whether texts may be cut into units.
        self.cuts = plain and found == (_SPACED_FILE if spaced else _BARE_FILE)
        self.control = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        self.largest = max(self.tokenizer.get_vocab().values())
        self.tokenize = self.tokenizer.model.tokenize
        self._reset()

    def _reset(self) -> None:
        self.index = HashIndex()
        self.pieces: dict[str, list[int]] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, dtype=np.int32)
        self.length = np.zeros(1 << 14, dtype=np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _ids(self, text: str) -> list[int]:
        """A unit's ids, by the library's model piece by piece."""
        if not _PLAIN.fullmatch(text) or self.control.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for piece in _SPACED_PIECES.findall(text) if self.spaced else _BARE_PIECES.findall(text.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                self.pieces[piece] = ids = [t.id for t in self.tokenize(piece.translate(_TO_ALPHABET))]
            out += ids
        return out

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        gc.disable()  # hundreds of thousands of short lists, none in a cycle
        try:
            ids = [self._ids(t) for t in texts]
        finally:
            gc.enable()
        n, k = self.index.n, len(texts)
        if n + k > len(self.start):
            grow = max(2 * len(self.start), n + k)
            self.start, self.length = (np.concatenate([x, np.zeros(grow - len(x), x.dtype)]) for x in (self.start, self.length))
        flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32)
        length = np.fromiter(map(len, ids), dtype=np.int64, count=k)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n : n + k], self.length[n : n + k] = self.used + np.cumsum(length) - length, length
        self.used += len(flat)
        self.index.add(hashes)
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()

    def units(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units."""
        if not self.spaced:
            return words(buf, offsets)
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = SPACE[buf]
        for m in _ODD_SPACE.finditer(buf.tobytes()):
            space[m.start() : m.end()] = True
        begin = flags_at(n, offsets)[:n].copy()
        begin[1:] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(begin)
        return start, np.append(start[1:], n)

    def unit_rows(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row in the cache of each unit."""
        if not len(start):
            return np.zeros(0, np.int64)
        keys = span_hash(prefix_hash(buf), start, end)
        rows = self.index.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            if self.index.n + len(distinct) > CACHE_UNITS[self.spaced] and self.index.n:
                self._reset()
                return self.unit_rows(buf, start, end)
            raw = buf.tobytes()
            at = new[first]
            self._learn(distinct, [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[at].tolist(), end[at].tolist())])
            rows[new] = self.index.find(keys[new])
        return rows

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and the offsets by text."""
        if not self.cuts:
            parts = [self.whole(buf[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        start, end = self.units(buf, offsets)
        rows = self.unit_rows(buf, start, end)
        length = self.length[rows]
        ids = self.flat[ragged(self.start[rows], length)]
        upto = np.concatenate([[0], np.cumsum(length)])
        return ids, upto[per_text(start, offsets)]

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's number of ids."""
        return np.diff(self.encode(buf, offsets)[1])
