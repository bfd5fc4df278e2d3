"""Secret scan: patterns, then structural confirmation of what they find.

Base spans come from three patterns.  The method then decodes base64 and hex
candidates of every text and parses them: ASN.1 (strict lengths down to the last byte) in the shapes of
PKCS#1, PKCS#8 (plain or encrypted), SEC1, DSA and SPKI keys, the fields of SSH wire strings and of OpenSSH private keys, PEM
bodies, and signed tokens (a base64url JSON header that names an
algorithm).  Only what parses is reported: ``token``, ``key``, and ``public`` for keys that are no secret (SPKI, PKCS#1 public, SSH
public); signatures and certificates have other shapes.  Base spans stay.

Whole texts are scanned, very long ones too, in one task and in proportion to their length: every run of characters is read
a fixed number of times, and candidates look up found keys by bisection.  A numpy pass over the bytes tells which texts can hold a candidate
at all; the patterns run on those.  Null texts count as empty; null ids, ids of any type and repeated rows pass, each row
for itself; spans that start together are in the order of kinds; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.store import small_batches
from claimloom.llm.textcore import text_chunks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "token", "key", "public")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_BASE64 = 8, 16, 32, 24
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: A part of a token: each character is read once, whatever stands before it.
_PART = re.compile(r"[A-Za-z0-9_-]+={0,2}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*KEY)-----([A-Za-z0-9+/=\s\\n]+?)-----END \1-----")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_IS_HEX = _table(_DIGITS + "abcdefABCDEF")
_IS_BASE64 = _table(_DIGITS + _LETTERS + _LETTERS.upper() + "+/_-")


#: Tags of ASN.1 (fixed values).
INTEGER, BIT_STRING, OCTET_STRING, OID, SEQUENCE, SET = 0x02, 0x03, 0x04, 0x06, 0x30, 0x31
#: Encoded starts of the identifiers of password-based encryption (PKCS#5 and PKCS#12).
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """``tag, first, end`` of the items that fill ``data[at:end]`` in strict encoding; ValueError if they do not."""
    out = []
    while at < end:
        if at + 2 > end:
            raise ValueError
        tag, n, body = data[at], data[at + 1], at + 2
        if n >= 0x80:
            k = n & 0x7F
            n = int.from_bytes(data[body : body + k], "big")
            if not 1 <= k <= 4 or body + k > end or data[body] == 0 or n < 0x80:
                raise ValueError
            body += k
        if body + n > end or (tag in (INTEGER, BIT_STRING, OID) and n == 0):
            raise ValueError
        out.append((tag, body, body + n))
        at = body + n
    return out


def _nested(data: bytes) -> list[tuple[int, int, int]]:
    """The items of the one SEQUENCE that ``data`` is, after all nested lengths have been checked."""
    top = der_items(data, 0, len(data))
    if len(top) != 1 or top[0][0] != SEQUENCE:
        raise ValueError
    todo = [top[0]]
    while todo:
        tag, a, b = todo.pop()
        todo += [x for x in der_items(data, a, b) if x[0] in (SEQUENCE, SET) or x[0] & 0xE0 == 0xA0]
    return der_items(data, *top[0][1:])


def der_key(data: bytes) -> str:
    """``key`` or ``public`` for one ASN.1 SEQUENCE that fills ``data``, with all nested lengths right, in the shape of such a key; else an empty string."""
    if len(data) < 16 or data[0] != SEQUENCE:
        return ""
    try:
        items = _nested(data)
        tags = [t for t, _, _ in items]
        size = [b - a for _, a, b in items]
        small = lambda i: int.from_bytes(data[items[i][1] : items[i][2]], "big") if size[i] == 1 else -1
        algorithm = lambda i: (inner := der_items(data, *items[i][1:])) and inner[0][0] == OID and data[inner[0][1] : inner[0][2]]
        secret = public = False
        if tags and all(t == INTEGER for t in tags):
            if len(tags) >= 9:  # PKCS#1 private: version, modulus, exponents, primes
                secret = small(0) in (0, 1) and size[1] >= 32
            elif len(tags) == 6:  # DSA private
                secret = small(0) == 0 and size[1] >= 32
            # PKCS#1 public: a long modulus and a short odd exponent (a signature has two numbers of like size)
            public = len(tags) == 2 and size[0] >= 64 and size[1] <= 8 and data[items[1][2] - 1] % 2 == 1
        elif tags[:3] == [INTEGER, SEQUENCE, OCTET_STRING]:  # PKCS#8
            secret = small(0) in (0, 1) and bool(algorithm(1)) and all(t & 0xE0 in (0xA0, 0x80) for t in tags[3:])
        elif tags[:2] == [INTEGER, OCTET_STRING]:  # SEC1
            secret = small(0) == 1 and size[1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
        elif tags == [SEQUENCE, BIT_STRING]:  # SPKI
            public = bool(algorithm(0)) and data[items[1][1]] == 0 and size[1] >= 17
        elif tags == [SEQUENCE, OCTET_STRING]:  # PKCS#8, encrypted
            secret = (algorithm(0) or b"").startswith(ENCRYPTION) and size[1] >= 16
        return "key" if secret else "public" if public else ""
    except (ValueError, IndexError):
        return ""


_KEY_TYPE = re.compile(rb"(ssh-|ecdsa-|sk-)[a-z0-9@.-]+$")


def _wire(data: bytes, at: int = 0, most: int = -1) -> tuple[list[bytes], int]:
    """Length-prefixed fields from ``at`` on (``most`` of them, or up to the last byte), and where they end; ValueError if they do not fit."""
    fields = []
    while len(fields) != most and (most >= 0 or at < len(data)):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data) or at + 4 > len(data):
            raise ValueError
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return fields, at


def ssh_key(data: bytes) -> str:
    """``public`` for SSH wire format up to the last byte, the first field a key type; ``key`` for an OpenSSH private key with all its fields; else an empty string."""
    magic = b"openssh-key-v1\0"
    try:
        if not data.startswith(magic):
            fields = _wire(data)[0]
            return "public" if len(fields) >= 2 and _KEY_TYPE.match(fields[0]) is not None and all(fields[1:2]) else ""
        (cipher, kdf, _), at = _wire(data, len(magic), 3)
        keys = int.from_bytes(data[at : at + 4], "big")
        if not cipher or not kdf or not 1 <= keys <= 64:
            return ""
        parts, at = _wire(data, at + 4, keys + 1)
        secret = parts.pop()
        if at != len(data) or not all(ssh_key(p) for p in parts) or len(secret) < 16:
            return ""
        return "key" if cipher != b"none" or secret[:4] == secret[4:8] else ""
    except ValueError:
        return ""


def _from_base64(s: str) -> bytes:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def signed_token(s: str) -> bool:
    try:
        head = json.loads(_from_base64(s.split(".")[0]))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return out


def token_spans(text: str) -> list[tuple[int, int]]:
    """``eyJ... . ... [. ...]``: parts side by side with one dot between them, the first from its first ``eyJ`` on."""
    out, begun, first, second = [], 0, None, None
    for m in [*_PART.finditer(text), None]:
        joins = m is not None and second is not None and m.start() == second + 1 and text[second] == "."
        if second is not None and not joins:
            # behind its dot the third part may hold no letter
            if text[second : second + 1] == ".":
                second += 1
                second += len(text[second : second + 2]) - len(text[second : second + 2].lstrip("="))
            out.append((begun, second))
            second = None
        elif joins:
            out.append((begun, m.end()))
            first = second = None
            continue
        if m is None:
            break
        if first is not None and m.start() == first + 1 and text[first] == ".":
            second, first = m.end(), None
            continue
        at = text.find("eyJ", m.start(), m.end())
        first, begun = (m.end(), at) if at >= 0 else (None, 0)
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(a, 3, b) for a, b in token_spans(text) if signed_token(text[a:b])] if "eyJ" in text else []
    kind = {"key": KINDS.index("key"), "public": KINDS.index("public")}

    def inside(at: int, spans: list[tuple[int, int]]) -> bool:
        i = bisect.bisect_right(spans, (at, len(text) + 1)) - 1
        return i >= 0 and at < spans[i][1]

    blocks, runs = [], []
    for m in _PEM.finditer(text):
        data = _from_base64(re.sub(r"\s|\\n", "", m[2]))
        if found := der_key(data) or ssh_key(data):
            out.append((m.start(), kind[found], m.end()))
            blocks.append(m.span())
    for m in _BASE64.finditer(text):
        data = _from_base64(m[0])
        if data and not inside(m.start(), blocks) and (found := der_key(data) or ssh_key(data)):
            out.append((m.start(), kind[found], m.end()))
            runs.append(m.span())
    for m in _ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and not inside(m.start(), blocks) and not inside(m.start(), runs) and (found := der_key(data := bytes.fromhex(m[0])) or ssh_key(data)):
            out.append((m.start(), kind[found], m.end()))
    return out


def _has_run(data: np.ndarray, table: np.ndarray, least: int, off: np.ndarray) -> np.ndarray:
    """Texts (flags) that may hold a run of ``least`` bytes of the table."""
    edge = np.concatenate([[-1], np.flatnonzero(~table[data]), [len(data)]])
    flags = np.zeros(len(off) - 1, bool)
    long = np.flatnonzero(np.diff(edge) > least)
    for a, b in zip(edge[long] + 1, edge[long + 1]):  # a run may go on in the next texts
        flags[np.searchsorted(off, a, "right") - 1 : np.searchsorted(off, b, "left")] = True
    return flags


def spans_of(text: str) -> tuple[list, list]:
    base = sorted(base_spans(text))
    return base, sorted(base + confirmed_spans(text))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches):
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        for a, _, data, off in text_chunks(batch.column(1)):
            n = len(off) - 1
            look = _has_run(data, _IS_HEX, MIN_HEX, off) | _has_run(data, _IS_BASE64, MIN_BASE64, off)
            raw = data.tobytes()
            low = raw.lower()
            for word, where in ((b"AKIA", raw), (b"eyJ", raw), (b"-----BEGIN", raw), *((w, low) for w in _WORDS)):
                at = where.find(word)
                while at >= 0:
                    i = int(np.searchsorted(off, at, "right")) - 1
                    look[i] = True
                    at = where.find(word, max(at + 1, int(off[i + 1])))
            count, sha, all_, sure = np.zeros((n, 3), np.int64), [nothing] * n, [""] * n, np.zeros(n, np.int64)
            for i in np.flatnonzero(look).tolist():
                base, spans = spans_of(raw[off[i] : off[i + 1]].decode("utf-8"))
                if spans:
                    count[i] = [sum(k == j for _, k, _ in base) for j in range(3)]
                    sha[i], all_[i], sure[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)
            yield pa.record_batch([batch.column(0).slice(a, n), *[pa.array(count[:, j]) for j in range(3)], pa.array(sha), pa.array(all_), pa.array(sure)], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])


def scanned(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: ``id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_scan, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
