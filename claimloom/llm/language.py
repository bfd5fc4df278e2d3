"""Language identification by Bayesian evidence fusion.

Text: a naive Bayes model over hashed byte trigrams, counted over all documents that state
a language.  For web pages three more kinds of evidence are multiplied in:

* the declared markup language and the address (path segment, last host label), by
  how often text of a language carries that value, counted over all pages;
* the host's prior: languages of the host's other pages, smoothed towards its domain's,
  which are smoothed towards those of all pages.

Counts are sums of the text model's posteriors (grouped aggregations), and a page's own share is
taken out of its host's.  Trigrams of one text depend on each other, so the weight of a longer text grows with the root of
their number (``ROOT_GRAMS``).  The model knows every stated language, however rare: counts are sparse, so a language costs what
its trigrams cost, and a row's scores are as many numbers as there are languages.  A rare language's unseen trigrams are as
unlikely as a common one's (``UNSEEN``), so junk does not look like it; one that a single document states knows only that document.

Null and empty texts have no text evidence and are rejected; null ids are ordinary ids; repeated
rows count each and share their decision, rows of one id with other texts are judged apart; of languages with equal scores the first by name is taken; a very long text
is read whole, at a cost in proportion to its length (tags that are never closed too); an
empty table gives an empty result; other columns, whatever their names, are untouched.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.store import fresh, small_batches, stored
from claimloom.llm.textcore import text_chunks

BUCKETS = 1 << 12
#: A text of n trigrams counts as so many independent ones times the root of n, at most n.
ROOT_GRAMS = 6.3
#: Share of a language's trigrams that is given to unseen ones at most, and what each bucket gets at most (in trigrams).
UNSEEN, PSEUDO = 0.02, 0.5
#: Languages that a counting task holds before it hands on its counts.
HELD = 256
#: Weight of the parent in a prior, in pages.
SMOOTHING = 5.0
#: Texts whose trigrams are, on average, so much less likely than uniform ones are no language.
FLOOR = -1.5
MIN_CONFIDENCE = 0.5
#: A host with more than this part of all rows is joined by broadcast (there are fewer than 1 / HOT_SHARE).
HOT_SHARE = 1e-3

#: A-Z as a-z; white space, digits and punctuation as one space.
_MAP = np.arange(256, dtype=np.uint8)
_MAP[:128] = [ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)]


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of consecutive texts, and their bounds."""
    m = _MAP[data].astype(np.uint32)
    if len(m) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    code = (m[:-2] << np.uint32(16)) | (m[1:-1] << np.uint32(8)) | m[2:]
    text = np.searchsorted(off, np.arange(len(code)), "right") - 1
    ok = (np.arange(len(code)) + 3 <= off[text + 1]) & ~((m[:-2] == 32) & (m[1:-1] == 32)) & ~((m[1:-1] == 32) & (m[2:] == 32))
    at = np.flatnonzero(ok)
    return (code[at] * np.uint32(2654435761) >> np.uint32(32 - 12)).astype(np.int64), np.searchsorted(at, off)


def _counter(batches):
    total: dict[str, np.ndarray] = {}

    def counts():
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])
        total.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, _, data, off in text_chunks(batch.column(1)):
            g, bound = grams(data, off)
            for i in range(len(off) - 1):
                if bound[i + 1] > bound[i]:
                    c = total.setdefault(langs[a + i], np.zeros(BUCKETS, np.int64))
                    c += np.bincount(g[bound[i] : bound[i + 1]], minlength=BUCKETS)
                    if len(total) > HELD:
                        yield from counts()
    yield from counts()


class TextModel:
    """Log probabilities of the buckets in each language: those seen, sparse, and one for all others."""

    def __init__(self, lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        order = np.argsort(lang, kind="stable")
        lang, bucket, n = lang[order], bucket[order], n[order]
        names, first = np.unique(lang, return_index=True)
        self.langs = [str(x) for x in names] or ["und"]
        self.seen, self.rest = [], []
        for a, b in zip(first, [*first[1:], len(lang)]):
            each = min(PSEUDO, UNSEEN * n[a:b].sum() / BUCKETS)
            total = n[a:b].sum() + each * BUCKETS
            self.seen.append((bucket[a:b].astype(np.int16), np.log((n[a:b] + each) / total)))
            self.rest.append(float(np.log(each / total)))
        if not self.seen:
            self.seen, self.rest = [(np.zeros(0, np.int16), np.zeros(0))], [float(-np.log(BUCKETS))]

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log likelihood above a uniform one (texts x languages), and numbers of trigrams."""
        g, bound = grams(data, off)
        n = np.diff(bound)
        out = np.zeros((len(off) - 1, len(self.langs)))
        for j, ((at, p), rest) in enumerate(zip(self.seen, self.rest)):
            logp = np.full(BUCKETS, rest)
            logp[at] = p
            total = np.concatenate([[0], np.cumsum(logp[g])])
            out[:, j] = (total[bound[1:]] - total[bound[:-1]]) / np.maximum(n, 1) - np.where(n > 0, np.log(1 / BUCKETS), 0)
        return out, n


def text_model(docs: DataFrame, text: str = "text", lang: str = "lang"):
    """The model (broadcast: for each stated language at most ``BUCKETS`` numbers) from all documents with a stated language."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull()).select(F.lower(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    got = rows.mapInArrow(_counter, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang_, bucket, n = (got.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    return docs.sparkSession.sparkContext.broadcast(TextModel(lang_.astype(str), bucket, n))


#: Elements whose content is no text of the page (fixed values), and where a comment or one of them begins and ends.
HIDDEN = ("script", "style", "noscript", "template", "title", "nav")
_OPEN = re.compile(rf"(?i)<!--|<({'|'.join(HIDDEN)})\b")
_CLOSE = {"": re.compile("-->")} | {k: re.compile(rf"(?i)</{k}\s*>") for k in HIDDEN}
_TAG = re.compile(r"<[^<>]*>")
_HTML = re.compile(r"(?i)<html\b[^>]*")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([A-Za-z]{2,3})""")


def page_text(source: str) -> str:
    """The text of a page, in time linear in its length: an element that is never closed is looked for once."""
    parts, done, at, unclosed = [], 0, 0, set()
    while m := _OPEN.search(source, at):
        kind, at = (m[1] or "").lower(), m.end()
        end = None if kind in unclosed else _CLOSE[kind].search(source, at)
        if end is None:
            unclosed.add(kind)
        else:
            parts.append(source[done : m.start()])
            done = at = end.end()
    return html.unescape(_TAG.sub(" ", " ".join([*parts, source[done:]])))


def declared_language(source: str) -> str | None:
    tag = _HTML.search(source)
    said = tag and _LANG.search(tag[0])
    return said[1].lower() if said else None


def address_parts(url: str | None) -> tuple[str, str, str, str | None]:
    """Host, registered domain (its last two labels), last label, language-like first path segment."""
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").lower()
    except ValueError:
        return "", "", "", None
    labels = host.split(".")
    segment = u.path.split("/")[1].lower() if u.path.count("/") else ""
    return host, ".".join(labels[-2:]), labels[-1], segment if re.fullmatch(r"[a-z]{2}(-[a-z]{2})?", segment) else None


def _evidence(model, pages: bool):
    """Batches of id, text[, address or host] -> evidence columns."""

    def run(batches):
        m = model.value
        for batch in batches:
            ids, texts, third = batch.columns[:3]
            for lo in range(0, len(texts), 256):
                part, where = texts.slice(lo, 256), third.slice(lo, 256).to_pylist()
                declared = batch.column(3).slice(lo, 256).to_pylist() if not pages else []
                if pages:
                    raw = [x or "" for x in part.to_pylist()]
                    declared = [declared_language(s) for s in raw]
                    part = pa.array([page_text(s) for s in raw], pa.string())
                    where = [address_parts(u) for u in where]
                else:
                    where = [("\0" if h is None else str(h), "", "", None) for h in where]
                    declared = [x.lower() if x else None for x in declared]
                for a, b, data, off in text_chunks(part):
                    avg, n = m.score(data, off)
                    ll = avg * np.minimum(n, ROOT_GRAMS * np.sqrt(n))[:, None]
                    p = np.exp(ll - ll.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    p[n == 0] = 0
                    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    w = where[a:b]
                    yield pa.record_batch(
                        [ids.slice(lo + a, b - a), *[pa.array([x[j] for x in w], pa.string()) for j in range(4)], pa.array(declared[a:b], pa.string()), lists(ll), lists(p), pa.array(n.astype(np.int64)), pa.array(avg.max(axis=1))],
                        names=["id", "host", "domain", "suffix", "segment", "declared", "ll", "p", "grams", "fit"],
                    )

    return run


_EVIDENCE = "host string, domain string, suffix string, segment string, declared string, ll array<double>, p array<double>, grams long, fit double"


def _sums(n: int) -> list[Column]:
    return [F.sum(F.get("p", F.lit(i))).alias(f"c{i}") for i in range(n)]


def _counts(n: int, cols: str = "c") -> Column:
    return F.array(*[F.coalesce(F.col(f"{cols}{i}"), F.lit(0.0)) for i in range(n)])


def fused(ev: DataFrame, langs: list[str]) -> DataFrame:
    """Add ``lang, confidence, host_prior`` to evidence rows."""
    n = len(langs)
    base = stored(ev.groupBy("host", "domain").agg(F.count(F.lit(1)).alias("rows"), *_sums(n)), "lang-hosts")
    n_rows, *everything = [float(x or 0) for x in base.agg(F.sum("rows"), *[F.sum(f"c{i}") for i in range(n)]).first()]
    total = sum(everything)
    world = F.array(*[F.lit((x + 1.0) / (total + n)) for x in everything])
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    toward = lambda c, parent: F.zip_with(c, parent, lambda x, q: (x + SMOOTHING * q) / (size(c) + SMOOTHING))
    domain = base.groupBy("domain").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]).select("domain", _counts(n).alias("dc"))
    is_hot = F.col("rows") > n_rows * HOT_SHARE
    prior = lambda hosts: hosts.select("host", "domain", _counts(n).alias("hc")).join(domain, "domain").select("host", "domain", "hc", toward(F.col("dc"), world).alias("parent"))
    hot = base.filter(is_hot)
    cold = ev.join(F.broadcast(hot.select("host", "domain")), ["host", "domain"], "left_anti").join(prior(base.filter(~is_hot)), ["host", "domain"])
    own = F.zip_with("hc", "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    rows = ev.join(F.broadcast(prior(hot)), ["host", "domain"]).unionByName(cold).withColumn("host_prior", toward(own, F.col("parent")))
    score = F.zip_with("ll", "host_prior", lambda a, q: a + F.log(q))
    for name in ("declared", "segment", "suffix"):
        # values that are no language of the model are one value; a missing one says nothing
        value = F.when(F.col(name).isNull() | (F.col(name) == ""), None).when(F.substring(name, 1, 2).isin(*langs), F.substring(name, 1, 2)).otherwise("other")
        table = {r["v"]: [float(x or 0) for x in r[1:]] for r in ev.groupBy(value.alias("v")).agg(*_sums(n)).collect() if r["v"] is not None}  # a row per language, and "other"
        all_ = [sum(c[i] for c in table.values()) for i in range(n)]
        like = F.lit(None).cast("array<double>")
        for v, c in table.items():
            like = F.when(value == v, F.array(*[F.lit(float(np.log((c[i] + 1.0) / (all_[i] + len(table))))) for i in range(n)])).otherwise(like)
        score = F.coalesce(F.zip_with(score, like, lambda a, b: a + b), score)
    rows = rows.withColumn("score", score).withColumn("top", F.array_max("score"))
    rows = rows.withColumn("confidence", 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    return rows.withColumn("lang", F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position("score", F.col("top")) - 1).cast("int"))).drop("score", "top")


def identified_pages(pages: DataFrame, model, id_col: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(source).alias("text"), F.col(url).alias("url"))
    ev = stored(rows.mapInArrow(_evidence(model, True), f"id {kind}, {_EVIDENCE}"), "lang-pages")
    return fused(ev, model.value.langs)


def identified_documents(docs: DataFrame, model, text: str = "text", source: str = "source", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The same for plain documents: the source is the host, the stated language the declared one."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(source).cast("string").alias("host"), F.col(lang).alias("declared"))
    ev = stored(rows.mapInArrow(_evidence(model, False), f"id {kind}, {_EVIDENCE}"), "lang-documents")
    return fused(ev, model.value.langs)


#: A text is kept when it has trigrams that look like the best language, and that language is more likely than all others.
KEPT = f"grams > 0 and fit >= {FLOOR} and confidence >= {MIN_CONFIDENCE}"

#: One too short for a trigram but not blank is decided by the declared language and the host alone.
KEPT_SHORT = f"grams = 0 and id.said and confidence >= {MIN_CONFIDENCE}"


def kept_documents(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose language is identified."""
    said = F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text, source, lang).alias("of"), said.alias("said"))
    rows = docs.select(row.alias("row"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(lang).alias("lang"))
    judged = identified_documents(rows, text_model(docs, text, lang), id_col="row")
    gone = judged.filter(f"not ({KEPT} or {KEPT_SHORT})")
    who, of = fresh(docs, "_id", "_of")
    gone = gone.select(F.col("id.id").alias(who), F.col("id.of").alias(of)).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(who)) & (F.xxhash64(text, source, lang) == F.col(of)), "left_anti")


def op3_language(spark, sf_dir: str) -> DataFrame:
    model = text_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = identified_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
    return out.select(F.col("id").alias("page_id"), "lang", F.col("confidence"), "declared", F.col("segment").alias("address_lang"), F.col("grams").alias("n_grams"), F.expr(KEPT).alias("kept"))
