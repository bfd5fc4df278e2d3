"""UTF-8 chunks against the standard library's decoder."""

import collections
import random

from claimloom.functions import utf8


def plain(data):
    out, at = [], 0
    while at < len(data):
        try:
            out.append((data[at:].decode(), b""))
            break
        except UnicodeDecodeError as e:
            out.append((data[at : at + e.start].decode(), data[at + e.start : at + e.end]))
            at += e.end
    return out


def test_chunks(spark):
    rng = random.Random(4)
    pieces = [b"a", b"plain", "é".encode(), "€".encode(), "\U0001f600".encode(), b"\x80", b"\xbf", b"\xc0", b"\xc1", b"\xc3", b"\xe2", b"\xe2\x82", b"\xe0\x80", b"\xe0\xa0", b"\xed\xa0\x80", b"\xf0\x9f", b"\xf0\x9f\x98", b"\xf0\x80", b"\xf4\x90", b"\xf5", b"\xff", b"\n"]
    rows = [(i, b"".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12)))) for i in range(3000)]
    rows += [(5000, None), (5001, b""), (5002, "ünï".encode() * 50_000), (5003, b"\xff" * 3000), (5004, "x\U0001f600".encode()[:-1])]
    want = collections.Counter((i, n, v, bytes(b)) for i, d in rows if d for n, (v, b) in enumerate(plain(d)))
    got = utf8.chunks(spark.createDataFrame(rows, "k long, raw binary"), "k", "raw").collect()
    assert collections.Counter((r.id, r.chunk, r.valid, bytes(r.invalid)) for r in got) == want


def test_all_short_strings():
    """Every string of two bytes, and of three over the bytes where ranges end."""
    import numpy as np

    edge = [0x00, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xEC, 0xED, 0xEF, 0xF0, 0xF3, 0xF4, 0xF5, 0xFF]
    strings = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes([a, b, c]) for a in edge for b in edge for c in edge] + [bytes([a, b, 0x80, c]) for a in edge for b in edge for c in edge]
    data, off = np.frombuffer(b"".join(strings), np.uint8), np.append(0, np.cumsum([len(s) for s in strings]))
    start, size, fine = utf8.runs(data, off)
    owner = np.searchsorted(off, start, "right") - 1
    got = [[] for _ in strings]
    for o, s, n, ok in zip(owner, start - off[owner], size, fine):
        if not ok:
            got[o].append((int(s), int(s + n)))
    for s, g in zip(strings, got):
        at, want = 0, []
        for v, b in plain(s):
            at += len(v.encode())
            if b:
                want.append((at, at + len(b)))
                at += len(b)
        assert g == want, s
