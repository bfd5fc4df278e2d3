"""Token ids of whole texts, by a byte-level BPE vocabulary file.

A text is cut where the vocabulary's own pre-tokeniser always cuts: before a
single space or line feed with a character that is no white space on either
side.  Units repeat a lot, so each distinct unit is encoded once per worker
(up to ``CACHE_UNITS``) and the ids of a batch are gathered by numpy.  ``tiktoken`` encodes the units,
with the ranks of the vocabulary file; tests hold its ids against ``tokenizers`` on the same file.
The string of a special token in a text gives that token's id, and what lies between such strings is encoded
apart, as ``tokenizers`` does; ``add_special_tokens=False`` only means that none is added.

Null and empty texts have no ids.  A text without any cut is one unit: a very long one is encoded at once and not kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from claimloom.llm.textcore import hash_spans, text_chunks

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_UNITS = 400_000
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LEAD2 = np.zeros(256, bool)  # leads of two-byte characters that are no white space
_LEAD2[0xC3:0xE0] = True
_NEXT = _ASCII | _LEAD2
_NEXT[0xE4:0xF5] = True
_loaded: dict[str, BytePairs] = {}


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = {k.encode(): v for k, v in special.items()}
        self.any_special = re.compile(b"|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True))) if special else None
        of = _byte_of_char()
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encode = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes that a token stands for
        self.length[list(ranks.values())] = [len(t) for t in ranks]
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of encoded units, ascending
        self.start = np.zeros(0, np.int64)  # in ``flat``
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def _append(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, joins: np.ndarray) -> None:
        """Encode units (``hashes`` ascending and new).

        Those cut by the pattern on both sides (``joins``) stay apart when they are put
        side by side, so one call encodes them all; the lengths of its tokens give the bounds.
        """
        start, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        many = np.flatnonzero(joins)
        if len(many):
            long = ends[many] - starts[many]
            upto = np.cumsum(long)
            text = data[np.repeat(starts[many] - upto + long, long) + np.arange(upto[-1])].tobytes().decode("utf-8")
            ids = np.array(self.encode(text), np.uint16)
            bound = np.searchsorted(np.cumsum(self.length[ids]), upto) + 1
            first = np.concatenate([[0], bound[:-1]])
            start[many], size[many] = self.used + first, bound - first
            self._append(ids)
        for i in np.flatnonzero(~joins).tolist():
            ids = np.array(self.encode(data[starts[i] : ends[i]].tobytes().decode("utf-8")), np.uint16)
            start[i], size[i] = self.used, len(ids)
            self._append(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.start, self.size = np.insert(self.known, at, hashes), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def _in_pieces(self, raw: bytes) -> np.ndarray:
        """The ids of one text with special strings."""
        out, done = [], 0
        for m in self.any_special.finditer(raw):
            out += [*self.encode(raw[done : m.start()].decode("utf-8")), self.special[m[0]]]
            done = m.end()
        return np.array(out + self.encode(raw[done:].decode("utf-8")), np.uint16)

    def _with_specials(self, data: np.ndarray, off: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a special string are encoded anew, in pieces."""
        raw, anew = data.tobytes(), {}
        if self.any_special is None or not self.any_special.search(raw):
            return ids, bound
        for m in self.any_special.finditer(raw):
            i = int(np.searchsorted(off, m.start(), "right")) - 1
            anew[i] = None
        for i in anew:
            anew[i] = self._in_pieces(raw[off[i] : off[i + 1]])
        parts = [anew.get(i, ids[bound[i] : bound[i + 1]]) for i in range(len(off) - 1)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of consecutive texts as uint16, their bounds)."""
        for a, _, data, off in text_chunks(texts):
            if len(self.known) > CACHE_UNITS:
                self._clear()
            cut = np.zeros(len(data) + 1, bool)
            if len(data) > 3:
                prev = _ASCII[data[1:-2]] | ((data[1:-2] >= 0x80) & (data[1:-2] < 0xC0) & _LEAD2[data[:-3]])
                here = (data[2:-1] == 0x20) | (data[2:-1] == 0x0A)
                cut[2:-2] = here & prev & _NEXT[data[3:]]
            # a cut needs its neighbours in the same text
            inner = off[1:-1]
            for d in (-2, -1, 0, 1, 2):
                at = inner + d
                cut[at[(at >= 0) & (at < len(cut))]] = False
            by_rule = cut.copy()
            cut[off[:-1][off[1:] > off[:-1]]] = True
            cut[len(data) :] = False
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(data))[: len(starts)]
            h = hash_spans(data, starts, ends)
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            at = np.searchsorted(self.known, u)
            new = np.ones(len(u), bool)
            new[at < len(self.known)] = self.known[at[at < len(self.known)]] != u[at < len(self.known)]
            if new.any():
                s, e = starts[first[new]], ends[first[new]]
                self._learn(u[new], data, s, e, by_rule[s] & by_rule[e])
            which = np.searchsorted(self.known, u)[inv]
            size = self.size[which]
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(self.start[which] - upto[:-1], size) + np.arange(upto[-1])] if len(which) else np.zeros(0, np.uint16)
            yield a, *self._with_specials(data, off, ids, upto[np.searchsorted(starts, off)])


def byte_pairs(path: str) -> BytePairs:
    """The vocabulary of a file, once per worker."""
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]
