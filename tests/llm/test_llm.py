"""Operators against brute force on whole small tables, and on null, empty, repeated and clashing input."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimloom.llm import exact, language, minhash, mixing, packing, secrets, sharding, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, queue int"
LONG = " ".join(f"w{i % 997}" for i in range(20_000))
ODD = [
    (1, None, None, None, None, 7, "x", 1),
    (2, "", "en", "a", 0, 7, "x", 1),
    (3, "  \n\t", "en", "a", 4, 7, None, 1),
    (4, LONG, "en", "a", 5, 7, "x", None),
    (5, LONG, "fr", "b", 5, 7, "x", 1),
    (5, LONG, "fr", "b", 5, 7, "x", 1),
    (6, "one two", "en", None, 7, 7, "x", 1),
    (None, "one  two", "en", "é", 7, 7, "x", 1),
    (8, "Ünï cödé \U0001f600 x", "de", "é", 7, 7, "x", 1),
]


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()


@pytest.fixture(scope="module", params=["odd", "none"])
def odd(request, spark):
    return spark.createDataFrame(ODD if request.param == "odd" else [], SCHEMA)


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates(spark, sf, docs):
    sets = {i: shingles(t or "", 3) for i, t in zip(docs.doc_id, docs.text)}
    where, shared = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for g in s:
            for j in where[g]:
                shared[j, i] += 1
            where[g].append(i)
    want = roots(sets, [p for p, n in shared.items() if 100 * n >= 85 * (len(sets[p[0]]) + len(sets[p[1]]) - n)])
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.op9_minhash(spark, sf).collect()}
    assert got == {i: (want[i], len(sets[i])) for i in sets}


def test_near_duplicates_large_group(spark):
    rng, base = np.random.default_rng(1), [f"t{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in rng.choice(150, rng.integers(0, 9), replace=False):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.id: r.component_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()}
    assert got == roots(sets, links)


def removal(docs):
    seen, out = set(), {}
    for i, t in sorted(zip(docs.doc_id, docs.text)):
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(g)
        out[i] = (len(w), keep.count(False), hashlib.sha256(" ".join(x for x, k in zip(w, keep) if k).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot, local", [(2048, 4), (1, 4), (2048, 1), (2048, 2)])
def test_substrings(spark, sf, docs, hot, local, monkeypatch):
    monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(substring, "LOCAL_HOT", local)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op2_substring(spark, sf).collect()}
    assert got == removal(docs)


def test_hot_windows_are_sent_by_their_least_place_only():
    """Of windows that a task meets again, only places before all met so far are searched; the rest are copies."""
    rng = np.random.default_rng(3)
    h = rng.integers(1, 2**62, 60).astype(np.uint64)
    least, witnessed, sent, gone, witnesses = substring._Least(), substring._Witnessed(), [], [], []
    for doc in (5, 9, 3, 9, 3, 1):
        rows = list(substring._singly([(7, doc, doc, 10, 41, 0), (7, doc, doc, 100, 41, 0)], least, witnessed, h))
        sent += [(r[1], r[3]) for r in rows if r[6] is None]
        gone += [(r[1], r[3]) for r in rows if r[6] is not None]
        witnesses += [r[0] for r in rows if r[6] is not None and r[5] is not None]
    assert sorted(sent) == sorted((d, 10 + j) for d in (5, 3, 3, 1) for j in range(41))
    assert len(sent) + len(gone) == 6 * 82 and (9, 10) in gone and (5, 100) in gone
    assert len(witnesses) == len(set(witnesses)) == 41


@pytest.mark.parametrize("hot, local", [(2048, 4), (1, 1)])
def test_the_index_reports_every_repeated_window(spark, sf, docs, hot, local, monkeypatch):
    """Matching statistics decide: what is removed was reported by the index, or has the words of a later window that it has reported."""
    monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(substring, "LOCAL_HOT", local)
    words = {i: WORD.findall(t or "") for i, t in zip(docs.doc_id.tolist(), docs.text)}
    places = collections.defaultdict(list)
    for i in sorted(words):
        for s in range(len(words[i]) - 19):
            places[tuple(words[i][s : s + 20])].append((i, s))
    got = {True: set(), False: set()}
    for r in substring.repeated(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        got[r.copy] |= {(r.doc, r.start + j) for j in range(r.windows)}
    searched = {g for g, at in places.items() if any(p in got[False] for p in at)}
    assert searched == {g for g, at in places.items() if len(at) > 1}
    assert got[True] | got[False] == {p for at in places.values() for p in at[1:]}
    assert got[True] and not any(at[0] in got[False] for at in places.values())


def test_fm_index():
    """Intervals and earliest places of an indexed text, and matching statistics of another one with unknown tokens."""
    rng = np.random.default_rng(0)
    t = np.append(rng.integers(1, 4, 400), 0).astype(np.int32)
    index = substring.FMIndex(t, 6)
    matched, interval = index.statistics(t, np.array([0]), np.array([400]))
    assert matched[:395].tolist() == [6] * 395 and matched[395:400].tolist() == [5, 4, 3, 2, 1]
    places = [[j for j in range(395) if (t[j : j + 6] == t[i : i + 6]).all()] for i in range(395)]
    assert index.earliest(interval[:395]).tolist() == [p[0] if len(p) > 1 else substring._LAST for p in places]
    other = rng.choice([1, 2, 3, 7, 9], 300, p=[0.3, 0.3, 0.3, 0.05, 0.05]).astype(np.int32)
    start, size = np.array([0, 40, 41, 200]), np.array([40, 1, 159, 100])
    matched, interval = index.statistics(other, start, size)
    raw = t.tobytes()
    inside = lambda x: any(raw.startswith(x.tobytes(), 4 * j) for j in range(400))
    for a, n in zip(start, size):
        for i in range(a, a + n):
            want = max(m for m in range(0, min(6, a + n - i) + 1) if inside(other[i : i + m]))
            assert matched[i] == want and (interval[i] >= 0) == (want == 6)


WEIGHTED = {"window": 64, "block_tokens": 5000, "grain": 16, "weights": "by source"}


@pytest.mark.parametrize("options", [{}, {"window": 16, "block_tokens": 200_000}, WEIGHTED])
def test_packing(spark, sf, docs, options):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = [(10**6, "a <|endoftext|> b", "x"), (10**6 + 1, None, None)]
    table = spark.createDataFrame([*zip(docs.doc_id.tolist(), docs.text, docs.source), *more], "doc_id long, text string, source string")
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, _ in table.collect()}
    if "weights" in options:
        options = options | {"weights": {r.source: 1.0 + i for i, r in enumerate(table.select("source").distinct().orderBy("source").collect())}}
    p = packing.packed(table, **options).toPandas()
    for r in p.itertuples():
        assert len(ids[r.id]) == r.doc_tokens and zlib.crc32(ids[r.id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    gapless = lambda g, at: (g.sort_values(at)[at].to_numpy() == np.concatenate([[0], np.cumsum(g.sort_values(at).length)[:-1]])).all()
    assert set(p.id) == set(ids) and all(gapless(g, "start") and g.length.sum() == g.doc_tokens.iloc[0] for _, g in p.groupby("id"))
    full = p.groupby("sequence_id").length.sum()
    assert all(gapless(g, "offset") for _, g in p.groupby("sequence_id")) and full.max() <= options.get("window", 1024) and ((full & (full - 1)) == 0).all()


def test_packing_follows_targets_over_blocks(spark):
    rows = [(i, f"w{i} " * 50, "ab"[i % 2]) for i in range(400)]
    p = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string"), window=128, grain=16, block_tokens=4000, weights={"a": 3, "b": 1}).toPandas()
    assert p.sequence_id.nunique() > 40 and p.groupby("id").length.sum().equals(p.groupby("id").doc_tokens.first())
    a, b = (p[p.queue == q].groupby("sequence_id").length.sum() for q in ("sa", "sb"))
    took = np.cumsum(np.stack([a.reindex(sorted(p.sequence_id.unique()), fill_value=0), b.reindex(sorted(p.sequence_id.unique()), fill_value=0)], 1), axis=0)
    both = took[took[:, 0] < a.sum() - 16]  # until a is empty, three of four ids are of a, up to the deficits
    assert len(both) > 20 and np.abs(both[:, 0] - both.sum(axis=1) * 0.75).max() <= 64
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights={"a": 1})


def test_deal_opens_with_deficits():
    take = packing.deal(np.array([500, 500]), [100] * 10, 50, np.array([-50.0, 50.0]))
    assert take[0].tolist() == [0, 100] and take.sum(axis=0).tolist() == [500, 500]


def test_deal_carries_deficits():
    counts = np.array([6000, 3000, 1000])
    sizes = packing.window_sizes(10_000, 1024)
    take = packing.deal(counts, sizes, 64)
    assert (take.sum(axis=0) == counts).all() and (take.sum(axis=1) == sizes).all()
    assert np.abs(np.cumsum(take[:8], axis=0) - np.outer(np.arange(1, 9) * 1024, counts / 10_000)).max() <= 128


def test_shards(spark, sf, docs):
    got = sharding.op8_sharding(spark, sf).toPandas().merge(docs, on="doc_id")
    n = got.groupby("shard").size().reindex(range(16), fill_value=0)
    assert n.max() - n.min() <= 1 and len(got) == len(docs)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got.itertuples())
    groups = got.groupby("text").shard.agg(["size", "nunique"])
    assert (groups["nunique"] <= np.ceil(groups["size"] / max(1, len(docs) // 128)) + 1).all()


def test_toxicity_risk():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        bad = rng.random() < 0.25
        f = np.unique(np.concatenate([rng.integers(0, 5000, 60), rng.integers(6000, 6010, 3) if bad else []]).astype(np.int32))
        rows.append((bad and i % 2 == 0, f, bad))
    vocab, w, b = toxicity.fit([(y, f) for y, f, _ in rows], 0.14)
    dense = np.zeros(toxicity.BUCKETS)
    dense[vocab] = w
    said = np.array([1 / (1 + np.exp(-(dense[f].sum() + b))) >= 0.3 for _, f, _ in rows])
    truth = np.array([t for _, _, t in rows])
    assert (said == truth).mean() > 0.95


def test_language(spark, sf):
    model = language.text_model(spark.read.parquet(f"{sf}/documents.parquet"))
    got = language.identified_documents(spark.read.parquet(f"{sf}/documents.parquet"), model).toPandas()
    assert (got.lang == got.declared).mean() > 0.95
    pages = spark.createDataFrame([(1, None, None), (2, "http://[bad", "<html lang=en>"), (3, "https://x.example.fr/fr/1", "<html lang='fr'><p>le la les et de"), (3, "https://x.example.fr/fr/1", "")], "page_id long, url string, html string")
    assert language.identified_pages(pages, model).count() == 4
    assert language.address_parts("https://A.b.Example.com/en/1?x")[:3] == ("a.b.example.com", "example.com", "com")


def test_rare_languages_stay(spark):
    """Five documents in ten thousand of a language, and one of another; junk of no language that looks like them goes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source", "lang")
    words = "вечер град дете живот земя история къща любов море народ огън песен река слънце трева улица хляб цвете човек школа".split()
    rng = np.random.default_rng(4)
    rare = [(1_000_000 + i, " ".join(rng.choice(words, 60)), "src1", "bg") for i in range(5)]
    rare += [(2_000_000, "τα παιδιά παίζουν στον κήπο και η γάτα κοιμάται στον ήλιο κάθε πρωί", "src2", "el")]
    junk = [(3_000_000 + i, " ".join("".join(rng.choice(list("qxzjkvwq#%"), 9)) for _ in range(60)), "src1", "en") for i in range(5)]
    table = docs.unionByName(spark.createDataFrame(rare + junk, "doc_id long, text string, source string, lang string"))
    model = language.text_model(table)
    assert model.value.langs == ["bg", "de", "el", "en", "es", "fr"]
    kept = {r.doc_id for r in language.kept_documents(table).select("doc_id").collect()}
    assert {r[0] for r in rare} <= kept and not {r[0] for r in junk} & kept
    said = {r.id: r.lang for r in language.identified_documents(table, model).filter("id >= 1000000").select("id", "lang").collect()}
    assert all(said[r[0]] == r[3] for r in rare)


def test_near_duplicate_ids(spark, tmp_path):
    """Two texts under one id: ``kept`` says that the id is its component's, for both rows."""
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (1, text + " extra"), (2, text), (3, None), (3, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.op9_minhash(spark, str(tmp_path)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]


def test_odd_tables(spark, odd):
    n = odd.count()
    assert exact.exact_dedup(odd).count() == n and substring.substring_dedup(odd).count() == n
    assert sharding.assigned(odd).count() == n and secrets.scanned(odd).count() == n
    assert mixing.planned(odd).count() == n and mixing.planned(odd, carry=False).count() == n
    assert exact.deduplicated(odd).count() == (4 if n else 0)
    assert sum(r.length for r in packing.packed(odd).collect()) >= n
    classes = minhash.classes(odd)
    assert classes.count() == n and set(minhash.deduplicated(odd).columns) == set(odd.columns)
    labels = spark.createDataFrame([(2, 1, 1), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(odd, toxicity.train(odd, labels)).filter("score between 0 and 1").count() == n
    assert language.kept_documents(odd).columns == odd.columns




def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = rows = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        rows = stage(spark, rows, sf).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, rows, sf).cache()
        assert rows.columns == docs.columns, name
        got = [r.doc_id for r in rows.select("doc_id").collect()]
        assert set(got) <= want and (name == "mix_sources" or len(got) == len(set(got)))
        want = set(got)
    out = p.STAGES[-1][1](spark, rows, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == want


@pytest.mark.parametrize("share", [1e-9, 2.0])
def test_language_hosts_joined_either_way(spark, sf, share, monkeypatch):
    model = language.text_model(spark.read.parquet(f"{sf}/documents.parquet"))
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = lambda: {(r.id, r.lang, round(r.confidence, 9)) for r in language.identified_pages(pages, model).collect()}
    want = rows()
    monkeypatch.setattr(language, "HOT_SHARE", share)
    assert rows() == want and len(want) == pages.count()


def test_language_judges_rows_of_one_id_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    text = docs.orderBy("doc_id").first()["text"]
    more = spark.createDataFrame([(-1, text, "en", "a"), (-1, text, "en", "a"), (-1, "", "en", "a"), (-1, None, None, None), (None, text, "en", "a"), (None, "", "en", "a")], docs.schema)
    got = language.kept_documents(docs.unionByName(more)).filter("doc_id = -1 or doc_id is null").collect()
    assert sorted((r.doc_id is None, r.text == text) for r in got) == [(False, True), (False, True), (True, True)]


def test_units_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", "　", "a", "Foo", "don't", "'s", "12", "\xe9", "\xdf", "漢", "\U0001f600", "é", "<|endoftext|>", ",", "\x00"]
    rnd = np.random.default_rng(5)
    texts = ["".join(parts[j] for j in rnd.integers(0, len(parts), rnd.integers(0, 40))) for _ in range(3000)] + ["", None, "a" * 20_000, " " * 3000, "a <|endoftext|> b", "<|endoftext|>"]
    enc, got = packing.byte_pairs(packing.default_tokenizer()), []
    for lo in range(0, len(texts), 500):
        for _, ids, bound in enc.batch(pa.array(texts[lo : lo + 500], pa.string())):
            got += [ids[a:b].tolist() for a, b in zip(bound, bound[1:])]
    assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("parts", [10**6, 1])
def test_exact_groups_joined_either_way(spark, docs, parts, monkeypatch):
    monkeypatch.setattr(exact, "HOT_PARTS", parts)
    rows = [(i, t) for i, t in zip(docs.doc_id.tolist(), docs.text)][:300]
    rows += [(1000 + i, "a b" if i % 2 else "a  b") for i in range(200)] + [(7777, "r")] * 50 + [(None, "r")]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, i))
    want = collections.Counter((i, min(g)[3], len(g)) for g in groups.values() for *_, i in g)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.exact_dedup(frame).collect()
    assert collections.Counter((r.id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.id == r.keep_id for r in got if r.kept)
    assert sorted(r.doc_id for r in exact.deduplicated(frame).collect()) == sorted(min(g)[3] for g in groups.values())


@pytest.mark.parametrize("sizes, free", [([2] * 20 + [3] * 5, 160), ([81, 300, 641, 640, 100, 90, 7], 8397), ([3000, 700, 41], 1259), ([5, 5, 2], 3)])
def test_shards_keep_groups_whole(spark, sizes, free):
    texts = [f"copied {g}" for g, size in enumerate(sizes) for _ in range(size)] + [f"single {i}" for i in range(free)]
    got = sharding.assigned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    n, quota = got.groupby("shard").size().reindex(range(16), fill_value=0), max(1, len(texts) // 16)
    assert sorted(got.id) == list(range(len(texts))) and n.max() - n.min() <= 1
    places = got.assign(text=[texts[i] for i in got.id]).groupby("text").shard.nunique()
    assert [places[f"copied {g}"] for g in range(len(sizes))] == [-(-size // quota) for size in sizes]


@pytest.mark.parametrize("positives, others, holding", [(9, 142, 4), (1000, 3000, 12)])
def test_toxicity_keeps_words_of_few_positives(positives, others, holding):
    rng = np.random.default_rng(3)
    common = lambda: rng.integers(0, 400, 30)
    rows = [(True, np.unique(np.append(common(), 500 if i < holding else 600)).astype(np.int32)) for i in range(positives)]
    rows += [(False, np.unique(common()).astype(np.int32)) for _ in range(others)]
    vocab, w, b = toxicity.fit(rows, 0.14)
    dense = np.zeros(toxicity.BUCKETS)
    dense[vocab] = w
    assert dense[500] > 10 * np.abs(dense[:400]).mean()


def test_toxicity_finds_some_of_a_small_table(spark, sf):
    got = toxicity.op1_toxicity(spark, sf).toPandas().merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    assert got.score.nunique() > 1 and got[got.toxic == 1].predicted.mean() > 0.5 > got[got.toxic == 0].predicted.mean()


@pytest.mark.parametrize("hot, local", [(2048, 4), (1, 4), (2048, 1), (2048, 2)])
def test_substrings_of_rows_that_share_an_id(spark, docs, hot, local, monkeypatch):
    monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(substring, "LOCAL_HOT", local)
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))
    a, b, c, d, e = (say(60) for _ in range(5))
    rows = [(1, a), (1, a), (2, f"{b} {say(5)} {c}"), (2, f"{say(3)} {b} {d}"), (2, f"{say(3)} {b} {d}"), (3, a)]
    rows += [(None, f"{say(40)} {d}"), (None, f"{say(90)} {e} {b}"), (None, e), (None, e), (None, say(200)), (None, None), (4, f"{e} {e}"), (5, say(30))]
    rows += list(zip((1000 + docs.doc_id).tolist(), docs.text))[:80]
    windows = [[tuple(w[s : s + 20]) for s in range(len(w) - 19)] for w in (WORD.findall(t or "") for _, t in rows)]
    place = lambda i, s: (rows[i][0] is None, rows[i][0] or 0, s)
    least = {}
    for i, ws in enumerate(windows):
        for s, g in enumerate(ws):
            least[g] = min(least.get(g, place(i, s)), place(i, s))
    want = collections.Counter()
    for i, (doc, t) in enumerate(rows):
        w = WORD.findall(t or "")
        keep = np.ones(len(w), bool)
        for s, g in enumerate(windows[i]):
            if least[g] < place(i, s):
                keep[s : s + 20] = False
        want[doc, len(w), int((~keep).sum()), hashlib.sha256(" ".join(np.array(w, object)[keep]).encode()).hexdigest()] += 1
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(tuple(r) for r in got) == want


def test_near_duplicates_of_rows_that_share_an_id(spark):
    say = lambda c, n=80: " ".join(f"{c}{i}" for i in range(n))
    near = lambda c: say(c) + " end"
    rows = [(1, say("a")), (2, near("a")), (2, say("b")), (3, near("b")), (4, say("c")), (None, near("c")), (None, say("d")), (None, near("d")), (None, ""), (None, say("e")), (5, say("f")), (5, near("f"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.classes(frame).collect()
    want = [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (None, 4), (None, None), (None, None), (None, None), (None, None), (5, 5), (5, 5)]
    assert collections.Counter((r.id, r.component_id) for r in got) == collections.Counter(want)
    left = collections.Counter((r.doc_id, (r.text or " ")[0]) for r in minhash.deduplicated(frame).collect())
    assert left == collections.Counter([(1, "a"), (2, "b"), (4, "c"), (None, "d"), (None, " "), (None, "e"), (5, "f")])


def test_language_keeps_short_texts_of_a_stated_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    host = docs.filter("lang = 'en'").groupBy("source").count().orderBy(F.desc("count")).first()["source"]
    more = spark.createDataFrame([(-1, "A.", "en", host), (-2, "é", "en", host), (-3, " ", "en", host), (-4, "", "en", host), (-5, None, "en", host)], docs.schema)
    got = language.kept_documents(docs.unionByName(more)).filter("doc_id < 0").collect()
    assert {r.doc_id for r in got} == {-1, -2}


def test_openings_of_chunks_over_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{q}", part << 32 | chunk, int(rng.integers(1, 10**6))) for q in range(3) for part in range(9) for chunk in range(7) if rng.random() < 0.8]
    got = {(r["queue"], r["chunk"]): (r["before"], r["n"]) for r in packing._opened(spark.createDataFrame(rows, "queue string, chunk long, n long")).collect()}
    assert got == {(q, c): (sum(m for p, d, m in rows if p == q and d < c), n) for q, c, n in rows}
