"""Queries and stages against SQL and plain-Python versions that share no code with the operators."""

import base64
import collections
import hashlib
import html
import itertools
import json
import math
import re
import zlib
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from claimloom.llm import exact, language, minhash, mixing, packing, secrets, sharding
from claimloom.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    c = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {table} AS FROM '{sf}/{table}.parquet'")
    mine, theirs = QUERIES[name](spark, sf).toPandas(), c.sql(ORACLES[name]).df()
    key = next(c for c in ("doc_id", "page_id", "conv_id") if c in mine.columns)
    plain = lambda f: f[sorted(f.columns)].sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(mine), plain(theirs), check_dtype=False, check_exact=False, rtol=1e-12)


# --- op1 ---


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_toxicity"](spark, sf).toPandas()
    assert len(got) == pq.read_table(f"{sf}/documents.parquet").num_rows
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    told = got.merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    told = told[told.held_out]
    bad, said = told.toxic == 1, told.predicted == 1
    assert (bad & said).sum() >= 0.6 * bad.sum() and (bad & said).sum() >= 0.8 * said.sum()


# --- op3: evidence fusion in plain Python ---


def trigrams(text):
    low = "".join(c for c in text).encode()
    m = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in low]
    grams = (m[i : i + 3] for i in range(len(m) - 2))
    return [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20 for a, b, c in grams if not (a == b == 32) and not (b == c == 32)]


def fuse(rows, docs):
    """``rows``: id, text, host, domain, suffix, segment, declared.  Returns id -> (language, confidence, mean fit, trigrams)."""
    counts = {}
    for text, lang in docs:
        c = counts.setdefault(lang.lower(), np.full(4096, 0.5))
        for g in trigrams(text or ""):
            c[g] += 1
    for c in counts.values():  # unseen trigrams have a fiftieth at most
        c += min(0.5, (c.sum() - 2048) / 50 / 4096) - 0.5
    langs = sorted(counts)
    logp = np.stack([np.log(counts[x] / counts[x].sum()) for x in langs])
    n, ev = len(langs), []
    for row in rows:
        g = trigrams(row[1])
        avg = logp[:, g].mean(axis=1) + math.log(4096) if g else np.zeros(n)
        ll = avg * min(len(g), 6.3 * math.sqrt(len(g)))
        p = np.exp(ll - ll.max())
        ev.append((ll, p / p.sum() if g else np.zeros(n), avg.max(), len(g)))
    host, domain, world = (collections.defaultdict(lambda: np.zeros(n)) for _ in range(3))
    for row, (_, p, _, _) in zip(rows, ev):
        host[row[2:4]] += p
        domain[row[3]] += p
        world[()] += p
    everyone = (world[()] + 1) / (world[()].sum() + n)
    toward = lambda c, q: (c + 5 * q) / (c.sum() + 5)
    value = lambda v: None if not v else v[:2] if v[:2] in langs else "other"
    tables = []
    for k in (6, 5, 4):
        t = collections.defaultdict(lambda: np.zeros(n))
        for row, (_, p, _, _) in zip(rows, ev):
            if value(row[k]) is not None:
                t[value(row[k])] += p
        total = sum(t.values())
        tables.append((k, {v: np.log((c + 1) / (total + len(t))) for v, c in t.items()}))
    out = collections.defaultdict(list)
    for row, (ll, p, fit, grams) in zip(rows, ev):
        own = np.maximum(host[row[2:4]] - p, 0)
        score = ll + np.log(toward(own, toward(domain[row[3]], everyone)))
        for k, t in tables:
            if value(row[k]) is not None:
                score = score + t[value(row[k])]
        out[row[0]].append((langs[int(score.argmax())], 1 / np.exp(score - score.max()).sum(), fit, grams))
    return out


def plain_page(source):
    hidden = r"(?is)<!--.*?-->|<(script|style|noscript|template|title|nav)\b.*?</\1\s*>"
    return html.unescape(re.sub(r"<[^<>]*>", " ", re.sub(hidden, " ", source)))


def plain_address(url):
    u = urlsplit(url)
    host, first = (u.hostname or "").lower(), u.path.split("/")[1].lower() if "/" in u.path else ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1], first if re.fullmatch("[a-z]{2}(-[a-z]{2})?", first) else None


def test_language_of_pages(spark, sf, docs):
    pages = pq.read_table(f"{sf}/pages.parquet").to_pandas()
    said = [re.search(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", h) for h in pages.html]
    rows = [(i, plain_page(h), *plain_address(u), m and m[1].lower()) for i, u, h, m in zip(pages.page_id, pages.url, pages.html, said)]
    want = fuse(rows, list(zip(docs.text, docs.lang)))
    got = QUERIES["op3_language"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        lang, confidence, fit, grams = want[r.page_id][0]
        assert (r.lang, r.n_grams, r.kept) == (lang, grams, grams > 0 and fit >= -1.5 and confidence >= 0.5)
        assert abs(r.confidence - confidence) < 1e-9


def test_page_text_is_linear_and_the_same(sf):
    for h in pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist():
        assert language.page_text(h) == plain_page(h)
    assert language.page_text("a<script>x</SCRIPT >b<!-- c --><nav>d") == "a b  d"
    assert len(language.page_text("<!-- <script> " * 200_000 + "<" * 500_000)) > 0
    assert language.declared_language("<html " * 200_000) is None


# --- op4: base spans by SQL, shapes of keys ---

SPANS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (FROM (VALUES (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8), (1, 'access', '(AKIA[A-Z0-9]+)', 1, 16), (2, 'hex', '([0-9a-f]+)', 1, 32)) AS v(o, kind, p, g, least)),
m AS (SELECT doc_id, o, kind, least, regexp_extract_all(t, p) AS whole, regexp_extract_all(t, p, g) AS part, string_split_regex(t, p) AS gaps FROM d, k),
s AS (SELECT doc_id, o, kind, i, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0) AS a, length(whole[i]) AS n, length(part[i]) >= least AS ok
      FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m)),
f AS (SELECT doc_id, string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, o) AS spans, count(*) FILTER (o = 0) AS na, count(*) FILTER (o = 1) AS nb, count(*) FILTER (o = 2) AS nc FROM s WHERE ok GROUP BY 1)
SELECT doc_id, coalesce(na, 0), coalesce(nb, 0), coalesce(nc, 0), sha256(coalesce(spans, '')), coalesce(spans, '') FROM d LEFT JOIN f USING (doc_id)"""


def test_base_spans(spark, docs, tmp_path):
    hard = ["é token: 'abcdefgh' Password=\"x\" api-key=1 API_KEY :  A/B+C=_.-9 secretsecret:abcdefghi x", "AKIA" + "B" * 12 + " AKIAAKIA" + "9" * 20 + " akia", "0" * 31 + "g" + "f" * 32 + "F", "token=" + "a" * 40, "passwd=password=12345678"]
    more = [*zip(docs.doc_id.tolist(), docs.text), *((10**6 + i, t) for i, t in enumerate(hard)), (10**7, None)]
    path = str(tmp_path / "documents.parquet")
    pd.DataFrame(more, columns=["doc_id", "text"]).to_parquet(path)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{path}'")
    want = {r[0]: r[1:] for r in c.sql(SPANS).fetchall()}
    for r in secrets.scanned(spark.read.parquet(path)).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[r.id][:4]
        base = [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert ",".join(base) == want[r.id][4] and r.n_confirmed == r.spans.count(":") // 2 - len(base)


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body


def number(n, size):
    return tlv(2, bytes([n]) if size == 1 else b"\x7f" + b"\x55" * (size - 1))


SEQ, OBJECT = lambda *p: tlv(0x30, *p), tlv(6, bytes.fromhex("2a864886f70d010101"))
RSA = SEQ(number(0, 1), number(0, 128), tlv(2, b"\x01\x00\x01"), *[number(0, 64) for _ in range(6)])
PBES = tlv(6, bytes.fromhex("2a864886f70d01050d"))
KEYS = {
    "pkcs1": RSA,
    "pkcs1 public": SEQ(number(0, 128), tlv(2, b"\x01\x00\x01")),
    "pkcs8": SEQ(number(0, 1), SEQ(OBJECT, tlv(5)), tlv(4, RSA)),
    "pkcs8 encrypted": SEQ(SEQ(PBES, SEQ(number(1, 1))), tlv(4, b"x" * 48)),
    "sec1": SEQ(number(1, 1), tlv(4, b"k" * 32), tlv(0xA0, OBJECT), tlv(0xA1, tlv(3, b"\0" + b"p" * 65))),
    "spki": SEQ(SEQ(OBJECT, tlv(5)), tlv(3, b"\0" + b"p" * 65)),
    "dsa": SEQ(number(0, 1), number(0, 128), number(0, 20), number(0, 128), number(0, 128), number(0, 20)),
}
FIELD = lambda b: len(b).to_bytes(4, "big") + b
PUBLIC = FIELD(b"ssh-ed25519") + FIELD(b"k" * 32)
OPENSSH = b"openssh-key-v1\0" + FIELD(b"none") + FIELD(b"none") + FIELD(b"") + (1).to_bytes(4, "big") + FIELD(PUBLIC) + FIELD(b"abcdabcd" + PUBLIC + b"\1\2\3")
NOT_KEYS = {
    "signature": SEQ(number(0, 32), number(0, 32)),
    "certificate": SEQ(SEQ(tlv(0xA0, number(2, 1)), number(0, 16), SEQ(OBJECT), SEQ()), SEQ(OBJECT), tlv(3, b"\0" + b"s" * 128)),
    "digest": SEQ(SEQ(tlv(6, bytes.fromhex("608648016503040201")), tlv(5)), tlv(4, b"h" * 32)),
    "cut": RSA[:-1],
    "one byte more": RSA + b"\0",
    "nested length": RSA[:9] + bytes([RSA[9] + 1]) + RSA[10:],
    "openssh magic": b"openssh-key-v1\0" + b"\0" * 40,
    "openssh cut": OPENSSH[:-1],
    "openssh checks": OPENSSH.replace(b"abcdabcd", b"abcdabce"),
    "ssh cut": PUBLIC[:-1],
    "text": b"just some words that mean nothing",
}


def test_structures():
    for name, data in (KEYS | {"ssh": PUBLIC, "openssh": OPENSSH}).items():
        kind = 5 if "public" in name or name in ("ssh", "spki") else 4
        b64, said = base64.b64encode(data).decode(), lambda t: [t[a:b] for a, k, b in secrets.spans_of(t)[1] if k == kind]  # noqa: B023
        assert said(f"x {b64} y") == [b64] and said(f"x {data.hex()} y") == [data.hex()], name
        pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64}\n-----END RSA PRIVATE KEY-----"
        assert said(f"é {pem}.") == [pem], name
    for name, data in NOT_KEYS.items():
        t = f"x {base64.b64encode(data).decode()} y {data.hex()}"
        assert not [s for s in secrets.spans_of(t)[1] if s[1] >= 4], name


def test_tokens():
    assert secrets.base_spans("\u017fecret=abcdefgh") == []  # only A-Z have another case here
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    good = ".".join([part(json.dumps({"alg": "HS256"}).encode()), part(b'{"a":1}'), "sig"])
    for head in (b'{"typ":"JWT"}', b'["alg"]', b'{"alg":1}', b'{"alg'):
        assert not [s for s in secrets.spans_of(f"{part(head)}.{part(b'{}')}.x")[1] if s[1] == 3]
    assert [s[1] for s in secrets.spans_of(f"({good})")[1]] == [3]


def test_token_parts_are_those_of_the_pattern():
    pattern = re.compile(r"eyJ[A-Za-z0-9_-]*={0,2}\.[A-Za-z0-9_-]+={0,2}(?:\.[A-Za-z0-9_-]*={0,2})?")
    rng = np.random.default_rng(5)
    for _ in range(20_000):
        t = "".join(rng.choice(["eyJ", "a", ".", "=", "b", " ", "eyJ."], rng.integers(1, 15)))
        assert secrets.token_spans(t) == [m.span() for m in pattern.finditer(t)], t


def test_hostile_texts_take_time_in_proportion():
    """Texts that took minutes when every start was tried anew."""
    import time

    key = base64.b64encode(KEYS["pkcs8"]).decode()
    block = f"-----BEGIN PRIVATE KEY-----{key}-----END PRIVATE KEY-----\n"
    for text, found in (("eyJ" * 300_000, 0), ("eyJ." * 200_000, 0), ("-----BEGIN KEY-----" * 50_000, 0), (f"{key} " * 20_000, 20_000), (block * 10_000, 10_000), ("token" * 100_000, 0), ("A A " * 200_000 + "KEY-----", 0)):
        t = time.time()
        assert sum(k >= 3 for _, k, _ in secrets.spans_of(text)[1]) == found
        assert time.time() - t < 20


# --- op8: cut edges ---


def least_cut(groups, quota):
    """Links between shards (all pairs of a group are linked), at the least, by trying all ways to deal the groups."""
    best = {tuple(quota): 0}
    for m in groups:
        new = {}
        for room, cut in best.items():
            for parts in itertools.product(*[range(min(r, m) + 1) for r in room]):
                if sum(parts) == m:
                    left = tuple(sorted(r - p for r, p in zip(room, parts)))
                    c = cut + math.comb(m, 2) - sum(math.comb(p, 2) for p in parts)
                    new[left] = min(new.get(left, c), c)
        best = new
    return min(best.values())


@pytest.mark.parametrize("groups, free", [([3, 3, 2, 2], 2), ([7, 2, 2], 5), ([4, 4, 4, 4], 0), ([5, 3, 3, 3], 2), ([2] * 7, 2), ([9, 4, 2], 1)])
def test_cut_edges(spark, groups, free):
    rows = [f"group {g}" for g, m in enumerate(groups) for _ in range(m)] + [f"free {i}" for i in range(free)]
    got = sharding.assigned(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shards=4).toPandas()
    n = len(rows)
    quota = [n // 4 + (s < n % 4) for s in range(4)]
    assert sorted(got.groupby("shard").size().reindex(range(4), fill_value=0)) == sorted(quota)
    text = got.assign(t=[rows[i] for i in got.id])
    cut = sum(math.comb(m, 2) for m in groups) - sum(math.comb(k, 2) for (t, _), k in text.groupby(["t", "shard"]).size().items())
    hashed = sum(math.comb(m, 2) for m in groups) * 3 / 4  # links that a plain hash of ids cuts, on average
    assert least_cut(groups, quota) <= cut <= max(least_cut(groups, quota), hashed / 2)


# --- the pipeline's stages, each on its predecessor's rows ---


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as p

    taken = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(p.STAGES)
    # language: fused as above, with the source as host and the stated language as the declared one
    rows = [(i, t or "", s, "", "", None, lang) for i, t, s, lang in zip(docs.doc_id, docs.text, docs.source, docs.lang)]
    want = fuse(rows, list(zip(docs.text, docs.lang)))
    keep = {i for i in docs.doc_id if want[i][0][3] > 0 and want[i][0][2] >= -1.5 and want[i][0][1] >= 0.5}
    first = stage["language_id"](spark, taken, sf).toPandas()
    assert set(first.doc_id) == keep
    best = {}
    for i, t in zip(first.doc_id, first.text):
        key, rank = re.sub(r"[\x20\x09-\x0D]", "", t), (-len(t), i)
        best[key] = min(best.get(key, rank), rank)
    second = stage["exact_dedup"](spark, spark.createDataFrame(first), sf).toPandas()
    assert set(second.doc_id) == {i for _, i in best.values()}
    sets = {}
    for i, t in zip(second.doc_id, second.text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    up = {i: i for i in sets}
    find = lambda i: i if up[i] == i else find(up[i])
    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    third = stage["near_dedup"](spark, spark.createDataFrame(second), sf).toPandas()
    assert set(third.doc_id) == {i for i in up if up[i] == i}
    documents = third  # noqa: F841  (read by the SQL)
    plan = duckdb.sql(mixing.OP10_SQL).df()
    want = collections.Counter({r.doc_id: r.taken // r.size for r in plan.itertuples() if r.taken})
    fourth = stage["mix_sources"](spark, spark.createDataFrame(third), sf).toPandas()
    assert collections.Counter(fourth.doc_id) == want
    last = stage["pack_sequences"](spark, spark.createDataFrame(fourth), sf).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in zip(fourth.doc_id, fourth.text)}
    assert last.groupby("doc_id").length.sum().to_dict() == {i: ids[i] * n for i, n in want.items()} and last.groupby("sequence_id").length.sum().max() <= 1024


# --- names that clash with the operators' own, ids of other types ---

CLASH = "doc_id long, text string, lang string, source string, _id string, _of string, _k string, _row string, _size int, _u int, _rank int, _target int, _source string, _source_size int, _theirs int, _b int, _v int"


def test_clashing_names(spark, docs):
    own = ("keep-me", "b", "c", "d", 1, 2, 3, 4, "e", 5, 6, 7, 8)
    rows = [(i, t, lang, s, *own) for i, t, lang, s in zip(docs.doc_id.tolist(), docs.text, docs.lang, docs.source)][:80]
    table = spark.createDataFrame(rows, CLASH)
    plain = table.select("doc_id", "text", "lang", "source")
    for f in (exact.deduplicated, minhash.deduplicated, language.kept_documents, mixing.mixed):
        got, want = f(table), f(plain)
        assert got.columns == table.columns
        got = got.collect()
        assert all(tuple(r)[4:] == own for r in got) and collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in want.collect())
    assert mixing.planned(table).count() == len(rows)


def test_text_ids(spark):
    rows = [("b", "x y", "en", "s"), ("a", "x  y", "en", "s"), ("c", "x y", "en", "t"), (None, "z", "en", None), ("é", None, "en", "t")]
    table = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(table).collect()}
    assert got == {"a": ("a", 3, True), "b": ("a", 3, False), "c": ("a", 3, False), None: (None, 1, True), "é": ("é", 1, True)}
    assert {r.doc_id for r in exact.deduplicated(table).collect()} == {"a", None, "é"}
    assert mixing.planned(table).count() == sharding.assigned(table).count() == secrets.scanned(table).count() == 5
    assert {r.id for r in packing.packed(table).collect()} == {"a", "b", "c", None, "é"}


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "one  two", None, None, 8), (4, "x " * 30_000, "en", "b", 60_000)]
    spark.createDataFrame(odd, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} <= {1, 2, 3, None, 4}
