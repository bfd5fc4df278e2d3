"""Substring deduplication with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one text.  Words covered by a window whose
words also start earlier (a smaller id, or earlier in the same text) are removed.

1. Scan: each window's anchor is its least hash of ``ANCHOR`` words.  Windows in a row with one anchor
   form a segment; of equal segments of a batch the first two are sent, and of those that a task has met twice only one that starts earlier than
   all before.  An anchor with ``LOCAL_HOT`` different segments in one batch is split: its segments are dealt by content, and a mark tells the anchor's own task.
2. Meet: segments are dealt by anchor.  Equal windows have equal anchors, so an anchor that occurs once ends here.
   Of equal segments the first stands for all in the index, and the next is their witness, which is streamed; both go to the shard of the first
   one's stretch of ``HOME`` words, joined to runs with their neighbours in the text.  What is left of equal segments are further copies.
3. Index: different segments of one anchor go to one shard too.  A shard holds word hashes in an FM-index over its
   runs (Burrows-Wheeler transform in a wavelet matrix of packed bits, bounds of the ``WINDOW``-deep intervals as packed bits,
   and a sampled suffix array that keeps the earliest place of each interval with several).  Each run is streamed through it
   from its last word: backward search extends the match by a word, and a match of ``WINDOW`` words is contracted to its
   interval.  Windows whose matching statistic reaches ``WINDOW`` and whose interval has an earlier place are reported.
   A split anchor, or one with more than ``HOT_SEGMENTS`` different segments (the flanks of a very common passage),
   is not sent to one shard: its windows are dealt singly, by their own hash, and of equal ones a task sends only those that start earlier than all before, and one witness.
4. Copies: a further copy has the words of a witness and starts later than the first; it goes where the index has reported the whole witness.
5. Remove: reported windows are taken from their texts.  Texts that cannot have any do not enter a shuffle.

A place is (id, start); only a strictly smaller one is earlier.  Rows are told apart by their id and a 64-bit hash of
their text (the key ``row``), so different texts under one id, or without one, are searched and cut each for itself;
rows that agree in both lose the same words, and none is a copy of another.

Words are compared by 64-bit hashes.  Null texts have no words; texts below ``WINDOW`` words keep all; null ids
count as one id after all others (as the largest long); a very long text is read whole by one task, in chunks of words, and its segments are dealt like others;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.bitset import maybe_in
from claimloom.llm.store import small_batches, stored
from claimloom.llm.textcore import _power, gram_hashes, hash_spans, mix64, sliding_argmin, text_chunks, word_spans

WINDOW = 20
ANCHOR = 8
#: Different segments of one anchor above which its windows are dealt singly: in the task of step 2, and within one batch of step 1.
HOT_SEGMENTS, LOCAL_HOT = 2048, 4
#: Bytes of all texts for each partition of step 2, and for each shard of step 3.
MEET_BYTES, SHARD_BYTES = 16 << 20, 2 << 20
#: Words of the stretches of a text whose repeated segments share a shard.
HOME = 512
#: A segment whose share of all further copies is above one in so many meets its witness by broadcast (there are fewer such segments).
HOT_PARTS = 1000
_LAST = np.iinfo(np.int64).max


def segments(h: np.ndarray, first: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """Of consecutive texts with word hashes ``h``: text, first word (in the chunk), windows, anchor and content hash of each segment."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    g, at = gram_hashes(h, first, anchor)
    full = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    full[at] = g
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    least = sliding_argmin(full, window - anchor + 1)[: len(h) - window + 1]
    ok = np.flatnonzero(np.arange(len(least)) + window <= first[text[: len(least)] + 1])
    if not len(ok):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    am, tx = least[ok], text[ok]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(am) != 0) | (np.diff(tx) != 0)]))
    start, count = ok[new], np.diff(np.append(new, len(ok)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _power(len(h), "up"))])
    content = mix64((total[start + count + window - 1] - total[start]) * _power(len(h) + 1, "down")[start] + count.astype(np.uint64))
    return tx[new], start, count, full[am[new]], content


def _in_order(anchor, content, doc, start, count, row):
    """Segments by anchor, content and place, rows that agree in id and text once."""
    order = np.lexsort((row, start, doc, content, anchor))
    cols = [x[order] for x in (anchor, content, doc, start, count, row)]
    same = np.ones(max(0, len(row) - 1), bool)
    for x in (cols[0], cols[1], cols[2], cols[3], cols[5]):
        same &= x[1:] == x[:-1]
    keep = np.append(True, ~same)[: len(row)]
    return [x[keep] for x in cols]


def _places(anchor, content, doc, start):
    """Of segments in order: which are the first of equal ones, and which start later than that."""
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))[: len(anchor)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return new, (doc != doc[first]) | (start != start[first])


def _second(new, again):
    """Of segments in order: the first of each run of equal ones that ``again`` marks."""
    at = np.flatnonzero(again)
    return at[np.unique(np.cumsum(new)[at], return_index=True)[1]]


class _Least:
    """The least place of each of some keys, as far as a task has read; keys are told apart by their anchor too."""

    def __init__(self):
        self.cols = [np.zeros(0, np.int64) for _ in range(4)]

    def look(self, key, anchor, doc, start):
        """Which keys are known, and which places start later than the one known."""
        k, a, d, s = self.cols
        if not len(k):
            return np.zeros(len(key), bool), np.zeros(len(key), bool)
        i = np.minimum(np.searchsorted(k, key), len(k) - 1)
        known = (k[i] == key) & (a[i] == anchor)
        return known, known & ((doc > d[i]) | ((doc == d[i]) & (start > s[i])))

    def learn(self, key, anchor, doc, start):
        key, anchor, doc, start = (np.concatenate(x) for x in zip(self.cols, (key, anchor, doc, start)))
        order = np.lexsort((start, doc, key))
        first = order[np.append(True, key[order][1:] != key[order][:-1])[: len(key)]]
        self.cols = [x[first] for x in (key, anchor, doc, start)]


PLAIN, COPY, SPLIT, MARK = range(4)


def _sender(local: int):
    def run(batches):
        least, hot = _Least(), np.zeros(0, np.int64)
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            parts = []
            for a, _, data, off in text_chunks(batch.column(1)):
                starts, ends, first = word_spans(data, off)
                tx, start, count, anchor, content = segments(hash_spans(data, starts, ends), first)
                parts.append((anchor.view(np.int64), content.view(np.int64), ids[a + tx], start - first[tx], count, keys[a + tx]))
            anchor, content, doc, start, count, row = _in_order(*(np.concatenate(x) for x in zip(*parts)))
            new, again = _places(anchor, content, doc, start)
            known, later = least.look(content, anchor, doc, start)
            head = np.flatnonzero(new)
            witness = _second(new, again & ~known)
            if len(head):
                often = head[np.logical_or.reduceat(again | known, head)]
                least.learn(content[often], anchor[often], doc[often], start[often])
            again |= later
            again[witness] = False
            group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)]) - 1
            many = np.unique(anchor[np.bincount(group, weights=new)[group] >= local]) if len(group) else anchor
            marks = np.setdiff1d(many, hot)
            hot = np.union1d(hot, marks)
            kind = np.where(again, COPY, np.where(np.isin(anchor, hot), SPLIT, PLAIN))
            # what is known to be repeated need not meet anything: it is dealt out evenly; segments of an anchor with many are dealt by content
            spread = mix64(np.arange(len(anchor)).astype(np.uint64) + doc.view(np.uint64)).view(np.int64)
            apart = mix64(anchor.view(np.uint64) + content.view(np.uint64)).view(np.int64)
            key = np.where(kind == COPY, spread, np.where(kind == SPLIT, apart, anchor))
            none = np.zeros(len(marks), np.int64)
            cols = [np.concatenate([x, y]) for x, y in zip((key, anchor, content, doc, start, count, row, kind), (marks, marks, none, none, none, none, none, none + MARK))]
            types = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int64, np.int8)
            yield pa.record_batch([pa.array(x.astype(t)) for x, t in zip(cols, types)], names=["key", "anchor", "content", "doc", "start", "windows", "row", "kind"])

    return run


SEEK, HOT, FIRST, WITNESS, FURTHER, REPORTED, VERDICT = range(7)
_MET = "doc long, row long, start int, windows int, role byte, anchor long, content long, home long"


def _meet(most: int):
    def run(batches):
        cols = [[] for _ in range(7)]
        for batch in batches:
            for c, x in zip(cols, batch.columns[1:]):
                c.append(x.to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        *cols, kind = (np.concatenate(c) for c in cols)
        sent = [c[kind == COPY] for c in cols]
        split = np.unique(cols[0][kind >= SPLIT])  # other tasks may hold segments of these anchors
        anchor, content, doc, start, count, row = cols = _in_order(*(c[(kind == PLAIN) | (kind == SPLIT)] for c in cols))
        new, copy = _places(anchor, content, doc, start)
        group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)]) - 1
        different = np.bincount(group, weights=new)[group] if len(group) else np.zeros(0)
        hot = np.isin(anchor, split) | (different > most)
        seek = np.flatnonzero(~copy & ((different > 1) | hot))
        witness = _second(new, copy)
        first = np.flatnonzero(new)[np.cumsum(new)[witness] - 1]
        home = mix64(doc[first].view(np.uint64) ^ mix64(row[first].view(np.uint64) + (start[first] // HOME).astype(np.uint64))).view(np.int64)
        further = copy.copy()
        further[witness] = False
        none = np.zeros(0, np.int64)
        for at, role, where in ((seek, np.where(hot[seek], HOT, SEEK), none), (first, FIRST, home), (witness, WITNESS, home), (np.flatnonzero(further), FURTHER, none), (None, FURTHER, none)):
            some = sent if at is None else [c[at] for c in cols]
            yield from _met_rows(some, np.broadcast_to(role, len(some[0])), where if len(where) else np.zeros(len(some[0]), np.int64))

    return run


def _met_rows(cols, role, home):
    anchor, content, doc, start, count, row = cols
    for lo in range(0, len(anchor), 100_000):
        i = slice(lo, lo + 100_000)
        yield pa.record_batch([pa.array(x[i]) for x in (doc, row, start.astype(np.int32), count.astype(np.int32), role.astype(np.int8), anchor, content, home)], names=["doc", "row", "start", "windows", "role", "anchor", "content", "home"])


class _Witnessed:
    """Windows of which a task has sent a witness."""

    def __init__(self):
        self.keys = np.zeros(0, np.int64)

    def unsent(self, key: np.ndarray) -> np.ndarray:
        """Places in ``key`` of one witness for each window that has none yet."""
        k, at = np.unique(key, return_index=True)
        at = at[~np.isin(k, self.keys)]
        self.keys = np.union1d(self.keys, key[at])
        return at


def _segs(anchor, content, windows, ask) -> bytes:
    return np.array([anchor, content, windows, ask], np.int64).tobytes()


def _singly(pieces, least: _Least, witnessed: _Witnessed, h: np.ndarray):
    """Of hot ``pieces`` ``(anchor, doc, row, start, windows, first word in h)``: each window to search by its own hash, and further copies.

    ``(key, doc, row, start, windows, words or None, segments or None)``; ``least`` holds the least place of each window that the task has met.
    """
    n = np.array([p[4] for p in pieces], np.int64)
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    anchor, doc, row, start, at = (np.array([p[i] for p in pieces], np.int64)[of] for i in (0, 1, 2, 3, 5))
    start, at = start + step, at + step
    g = np.concatenate([gram_hashes(h[p[5] : p[5] + p[4] + WINDOW - 1], np.array([0, p[4] + WINDOW - 1]), WINDOW)[0] for p in pieces]).view(np.int64)
    order = np.lexsort((start, doc, anchor, g))
    new, again = _places(anchor[order], g[order], doc[order], start[order])
    gone = np.zeros(len(g), bool)
    gone[order] = again
    gone |= least.look(g, anchor, doc, start)[1]
    first = order[new]
    least.learn(g[first], anchor[first], doc[first], start[first])
    copies = np.flatnonzero(gone)
    witness = np.zeros(len(g), bool)
    witness[copies[witnessed.unsent(g[copies])]] = True
    spread = mix64(np.arange(len(g)).astype(np.uint64) + doc.view(np.uint64)).view(np.int64)
    for i in range(len(g)):
        words = None if gone[i] and not witness[i] else h[at[i] : at[i] + WINDOW].tobytes()
        segs = _segs([anchor[i]], [g[i]], [1], [1]) if gone[i] else None
        yield int(g[i] if words else spread[i]), int(doc[i]), int(row[i]), int(start[i]), 1, words, segs


def _runs(of, start, n, role, anchor, content, home, at, h):
    """Segments of repeated stretches, neighbours in one text and shard joined: ``(key, text, start, windows, words, segments or None)``."""
    order = np.lexsort((start, of))
    of, start, n, role, anchor, content, home, at = (x[order] for x in (of, start, n, role, anchor, content, home, at))
    head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (home[1:] != home[:-1]) | (start[1:] != start[:-1] + n[:-1]))[: len(of)])
    for a, b in zip(head.tolist(), np.append(head[1:], len(of)).tolist()):
        m = int(n[a:b].sum())
        ask = role[a:b] == WITNESS
        yield int(home[a]), int(of[a]), int(start[a]), m, h[at[a] : at[a] + m + WINDOW - 1].tobytes(), _segs(anchor[a:b], content[a:b], n[a:b], ask) if ask.any() else None


def _fetch(shards: int):
    names = ["shard", "doc", "row", "start", "windows", "words", "segs"]

    def run(batches):
        least, witnessed = _Least(), _Witnessed()
        for batch in batches:
            docs, keys, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            flat = places.flatten()
            owner = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
            of_place = [flat.field(c).to_numpy().astype(np.int64) for c in ("start", "windows", "role", "anchor", "content", "home")]
            out = [[] for _ in _FETCHED]
            for a, _, data, off in text_chunks(batch.column(2)):
                starts, ends, first = word_spans(data, off)
                h = hash_spans(data, starts, ends)
                lo, hi = np.searchsorted(owner, [a, a + len(off) - 1])
                of = owner[lo:hi]
                start, n, role, anchor, content, home = (x[lo:hi] for x in of_place)
                at = first[of - a] + start
                hot, pair = np.flatnonzero(role == HOT), np.flatnonzero(role >= FIRST)
                rows = [(int(anchor[i]), docs[of[i]], keys[of[i]], int(start[i]), int(n[i]), h[at[i] : at[i] + n[i] + WINDOW - 1].tobytes(), None) for i in np.flatnonzero(role == SEEK).tolist()]
                rows += [(key, docs[i], keys[i], *rest) for key, i, *rest in _runs(*(x[pair] for x in (of, start, n, role, anchor, content, home, at)), h)]
                if len(hot):
                    rows += _singly([(anchor[i], docs[of[i]], keys[of[i]], start[i], n[i], at[i]) for i in hot.tolist()], least, witnessed, h)
                for key, *rest in rows:
                    for c, x in zip(out, (key % shards, *rest)):
                        c.append(x)
                if len(out[0]) > 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(out, _FETCHED)], names=names)
                    out = [[] for _ in _FETCHED]
            if out[0]:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, _FETCHED)], names=names)

    return run


_FETCHED = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


class Bits:
    """Packed bits with rank (ones before a position) and select (the position of a one)."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.ones[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, k, "right") - 1
        left, at, word = k - self.ones[w], np.zeros(len(k), np.uint64), self.words[w]
        for half in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(word >> at & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= below
            left = left - np.where(up, below, 0)
            at = at + np.where(up, half, 0).astype(np.uint64)
        return w * 64 + at.astype(np.int64)


class FMIndex:
    """An index of ``tokens`` (0 parts segments and is the last), searched for patterns of up to ``depth`` tokens.

    Kept: the Burrows-Wheeler transform in a wavelet matrix, the bounds of the intervals of suffixes that agree in ``depth`` tokens,
    and of each such interval with several suffixes the least number ``when`` of its places (by default the place itself).
    """

    def __init__(self, tokens: np.ndarray, depth: int, when: np.ndarray | None = None):
        n, self.depth = len(tokens), depth
        rank, long = tokens.astype(np.int64), 1
        while long < depth:  # ranks by ``long`` tokens, from those by fewer
            step = min(long, depth - long)
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1]
            long += step
        places = np.argsort(rank, kind="stable")
        first = np.append(True, np.diff(rank[places]) != 0)[:n]
        starts = np.flatnonzero(first)
        several = np.diff(np.append(starts, n)) > 1
        self.bounds, self.several, self.intervals, self.n = Bits(first), Bits(several), len(starts), n
        self.least = np.minimum.reduceat((np.arange(n) if when is None else when)[places], starts)[several]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(tokens))])
        bwt = tokens[places - 1]
        self.levels = []
        for level in reversed(range(max(1, int(tokens.max()).bit_length()))):
            bit = bwt >> level & 1
            self.levels.append((level, Bits(bit), n - int(bit.sum())))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        every = np.arange(len(self.before) - 1)
        self.begin = self._descend(every, np.zeros(len(every), np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            k = bits.rank(i)
            i = np.where(c >> level & 1, zeros + k, i - k)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of ``c`` before the patterns of the ranges; empty for a token that the index does not know."""
        known = (c > 0) & (c < len(self.before) - 1)
        c = np.where(known, c, 0)
        both = self._descend(np.concatenate([c, c]), np.concatenate([lo, hi])).reshape(2, -1) + (self.before[c] - self.begin[c])
        return np.where(known, both[0], 0), np.where(known, both[1], 0)

    def _shorter(self, tokens: np.ndarray, at: np.ndarray, length: np.ndarray):
        """The longest matches of at most ``length`` tokens at places where an extension has failed."""
        length, lo, hi = length.copy(), np.zeros(len(at), np.int64), np.full(len(at), self.n)
        todo = np.flatnonzero(length > 0)
        while len(todo):
            a, b = np.zeros(len(todo), np.int64), np.full(len(todo), self.n)
            for back in range(int(length[todo].max()) - 1, -1, -1):
                on = np.flatnonzero((back < length[todo]) & (a < b))
                a[on], b[on] = self.extend(tokens[at[todo[on]] + back], a[on], b[on])
            hit = a < b
            lo[todo[hit]], hi[todo[hit]] = a[hit], b[hit]
            todo = todo[~hit]
            length[todo] -= 1
            lo[todo[length[todo] == 0]], hi[todo[length[todo] == 0]] = 0, self.n
            todo = todo[length[todo] > 0]
        return length, lo, hi

    def statistics(self, tokens: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed texts ``tokens[start : start + size]``.

        For each token of ``tokens``: how many tokens from there on occur in the index (``depth`` at most, and within its text), and where that is
        ``depth``, the interval's number (else -1).  All texts are streamed side by side, each from its end.
        """
        matched, interval = np.zeros(len(tokens), np.int32), np.full(len(tokens), -1)
        order = np.argsort(-size, kind="stable")
        at, size = (start + size)[order], size[order]
        lo, hi, length = np.zeros(len(at), np.int64), np.full(len(at), self.n), np.zeros(len(at), np.int64)
        for step in range(1, int(size.max(initial=0)) + 1):
            live = int(np.searchsorted(-size, -step, "right"))  # texts of at least so many tokens
            i = at[:live] - step
            a, b = self.extend(tokens[i], lo[:live], hi[:live])
            grown = np.minimum(length[:live] + 1, self.depth)
            lost = np.flatnonzero(a >= b)
            if len(lost):
                grown[lost], a[lost], b[lost] = self._shorter(tokens, i[lost], length[lost])
            full = np.flatnonzero(grown == self.depth)
            if len(full):
                g = self.bounds.rank(a[full] + 1) - 1
                interval[i[full]] = g
                a[full] = self.bounds.select(g)
                last = g + 1 == self.intervals
                b[full] = np.where(last, self.n, self.bounds.select(np.where(last, 0, g + 1)))
            lo[:live], hi[:live], length[:live] = a, b, grown
            matched[i] = grown
        return matched, interval

    def earliest(self, interval: np.ndarray) -> np.ndarray:
        """The least number of each interval's places; that of an interval with one place is not kept (the largest long)."""
        out = np.full(len(interval), _LAST)
        known = np.flatnonzero(interval >= 0)
        g = interval[known]
        some = self.several.rank(g + 1) > self.several.rank(g)
        out[known[some]] = self.least[self.several.rank(g[some])]
        return out


_FOUND = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("role", pa.int8()), ("anchor", pa.int64()), ("content", pa.int64())])


def _found(role: int, doc, row, start, windows, anchor=None, content=None) -> pa.Table:
    cols = [np.zeros(len(doc), np.int64) if c is None else np.asarray(c) for c in (doc, row, start, windows, np.full(len(doc), role), anchor, content)]
    return pa.table([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(cols, _FOUND)], schema=_FOUND)


def _search(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    copies = t.filter(t.column("words").is_null())
    segs = np.frombuffer(b"".join(copies.column("segs").to_pylist()), np.int64).reshape(-1, 4)
    further = _found(FURTHER, *(copies.column(c).to_numpy() for c in ("doc", "row", "start", "windows")), segs[:, 0], segs[:, 1])
    t = t.filter(t.column("words").is_valid())
    return pa.concat_tables([further, *_indexed(t)]) if len(t) else further


def _indexed(t: pa.Table) -> list[pa.Table]:
    """What matching statistics report: runs of windows that start earlier, and the segments of witnesses that are such runs throughout."""
    t = t.sort_by([("doc", "ascending"), ("row", "ascending"), ("start", "ascending")])
    doc, row, start, count = (t.column(c).to_numpy().astype(np.int64) for c in ("doc", "row", "start", "windows"))
    size = count + WINDOW - 1
    words = np.frombuffer(b"".join(t.column("words").to_pylist()), np.uint64)
    ids = np.unique(words, return_inverse=True)[1].astype(np.int32) + 1
    base = np.cumsum(size + 1) - size - 1
    tokens = np.zeros(int((size + 1).sum()), np.int32)
    inside = np.ones(len(tokens), bool)
    inside[base + size] = False
    tokens[inside] = ids
    owner, begin = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
    at = base[owner] + np.arange(len(owner)) - begin[owner]
    when = np.full(len(tokens), _LAST)
    when[at] = np.unique(doc, return_inverse=True)[1][owner] * (int((start + count).max()) + 1) + start[owner] + at - base[owner]
    index = FMIndex(tokens, WINDOW, when)
    matched, interval = index.statistics(tokens, base, size)
    hit = (matched[at] >= WINDOW) & (index.earliest(interval[at]) < when[at])
    runs = np.flatnonzero(hit)
    new = np.flatnonzero(np.append(True, np.diff(at[runs]) != 1)[: len(runs)])
    i = owner[runs[new]]
    out = [_found(REPORTED, doc[i], row[i], start[i] + at[runs[new]] - base[i], np.diff(np.append(new, len(runs))))]
    asked = [(first, np.frombuffer(segs, np.int64).reshape(4, -1)) for first, segs in zip(begin.tolist(), t.column("segs").to_pylist()) if segs]
    if asked:
        anchor, content, n, ask = np.concatenate([segs for _, segs in asked], axis=1)
        head = np.concatenate([first + np.cumsum(segs[2]) - segs[2] for first, segs in asked])
        upto = np.append(0, np.cumsum(hit))
        whole = np.flatnonzero((ask == 1) & (upto[head + n] - upto[head] == n))
        none = np.zeros(len(whole), np.int64)
        out.append(_found(VERDICT, none, none, none, none, anchor[whole], content[whole]))
    return out


def _finish(with_places: bool):
    def run(batches):
        for batch in batches:
            places = batch.column(2).to_pylist() if with_places else None
            for a, _, data, off in text_chunks(batch.column(1)):
                raw, n = data.tobytes(), len(off) - 1
                total, gone, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), []
                for i in range(n):
                    words = raw[off[i] : off[i + 1]].split()
                    total[i] = len(words)
                    if places and places[a + i]:
                        keep = np.ones(len(words), bool)
                        for p in places[a + i]:
                            keep[p["start"] : p["start"] + p["windows"] + WINDOW - 1] = False
                        words = [words[j] for j in np.flatnonzero(keep).tolist()]
                        gone[i] = total[i] - len(words)
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.record_batch([batch.column(0).slice(a, n), pa.array(total), pa.array(gone), pa.array(sha)], names=["id", "n_words", "n_removed", "kept_sha256"])

    return run


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """``id, text, doc, row``: the place of a row and the key that tells it from others there."""
    own = F.col(id_col).cast("long")
    return docs.select(own.alias("id"), F.col(text).alias("text"), F.coalesce(own, F.lit(_LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"))


def repeated(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc, row, start, windows, copy``: runs of windows (by first word) that also start earlier; a null id is the largest long.

    ``copy``: has the words of a witness that the index has reported (else reported itself).
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs, text, id_col).select("doc", "text", "row")
    sent = rows.mapInArrow(_sender(LOCAL_HOT), "key long, anchor long, content long, doc long, start int, windows int, row long, kind byte")
    met = stored(sent.repartition(max(own, size // MEET_BYTES), "key").mapInArrow(_meet(HOT_SEGMENTS), _MET), "sub-met")
    searched = met.filter(F.col("role") != FURTHER)
    seek = searched.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "windows", "role", "anchor", "content", "home")).alias("places"))
    hits = maybe_in(F.xxhash64("doc", "row"), searched.select(F.xxhash64("doc", "row").alias("h")).distinct())
    shards = max(16, size // SHARD_BYTES)
    content = rows.filter(hits).join(seek, ["doc", "row"]).dropDuplicates(["doc", "row"]).select("doc", "row", "text", "places").mapInArrow(_fetch(shards), "shard long, doc long, row long, start int, windows int, words binary, segs binary")
    found = stored(content.groupBy("shard").applyInArrow(_search, "doc long, row long, start int, windows int, role byte, anchor long, content long"), "sub-found")
    runs = ["doc", "row", "start", "windows"]
    further = met.unionByName(found, allowMissingColumns=True).filter(F.col("role") == FURTHER).select(*runs, "anchor", "content")
    gone = stored(_confirmed(further, found.filter(F.col("role") == VERDICT).select("anchor", "content").distinct()).select(runs), "sub-copies")
    return found.filter(F.col("role") == REPORTED).select(*runs, F.lit(False).alias("copy")).union(gone.withColumn("copy", F.lit(True)))


def _confirmed(further: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Copies whose witness the index has reported; those of the most copied segments meet it by broadcast."""
    key = ["anchor", "content"]
    counts = stored(further.groupBy(key).agg(F.count("*").alias("n")).join(verdicts, key, "left_semi"), "sub-counts")
    often = F.col("n") * HOT_PARTS > (counts.agg(F.sum("n")).first()[0] or 0)
    hot, rest = counts.filter(often).select(key), counts.filter(~often).select(key)
    return further.join(F.broadcast(hot), key, "left_semi").unionByName(further.join(F.broadcast(hot), key, "left_anti").join(rest, key, "left_semi"))


def substring_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: ``id, n_words, n_removed, kept_sha256``."""
    gone = repeated(docs, text, id_col)
    rows = _keyed(docs, text, id_col)
    hit = maybe_in(F.xxhash64("doc", "row"), gone.select(F.xxhash64("doc", "row").alias("h")).distinct())
    out = "id long, n_words long, n_removed long, kept_sha256 string"
    whole = rows.filter(~hit).select("id", "text").mapInArrow(_finish(False), out)
    places = gone.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "windows")).alias("places"))
    cut = rows.filter(hit).join(places, ["doc", "row"], "left").select("id", "text", "places").mapInArrow(_finish(True), out)
    return whole.unionByName(cut)


def op2_substring(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP2_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, greatest(1, len(w) - 18))) AS i, unnest(list_transform(range(1, greatest(1, len(w) - 18)), lambda i: sha256(array_to_string(w[i:i + 19], ' ')))) AS h FROM w),
later AS (SELECT doc_id, i FROM x QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, 20) AS t(k)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
