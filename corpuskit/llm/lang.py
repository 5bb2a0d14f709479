"""Problem 4: a language and a confidence for every token, block and document.

Method: Bayesian evidence fusion. For a token: the log likelihood of the declared labels that its word carries in the
whole corpus, under each language, by a matrix of how labels go wrong that is itself estimated from the corpus; the log
likelihood of its letter groups, tempered, which decides for words not met; and the log prior of its host. For a block
or document: the log likelihood of its words' languages given the text's language, the log likelihood of its declared
language, and the log prior of its host. A host's prior is its declared languages smoothed towards those of its address
suffix and of the whole corpus, all by grouped aggregation. The script limits a word's languages.

``KNOWN`` is the share of a text's words that are in its language. It is set so high that one word more outweighs
declared language and host together: a block is in the language of most of its words, and the other evidence settles
ties and uncertain words. Declared languages are taken as right with ``DECLARED``.

The model is a table of fixed size, whatever the corpus: counts by label of every word (as it is spelt, and with repeated
letters written once), host and suffix, added up at two hashed places of ``BUCKETS`` each; the place with fewer counts is
read. Counts are exact as long as a key is alone at one of its places; nothing is left out. 80 MB at most.

Cases: null and empty texts give no units; blocks without letters give none; a missing, short or null label array means
missing labels; ties go to the earlier of RAJ/HIN or ENG/TRL; repeated rows give one row in p4_found; without any labels
letter groups know nothing and the prior decides; empty tables give an empty result. A token's own label is part of its
word's evidence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuskit.functions.session import cut
from corpuskit.llm.canon import plain, plain_map, spelt, spoken
from corpuskit.llm.privacy import ADDRESS, EMAIL, IDS, MAILED, PHONE

# The language labels.
LANGS = ("RAJ", "HIN", "ENG", "TRL")
BUCKETS, GROUPS = 1 << 20, 1 << 16
KNOWN, DECLARED, SMOOTH = 0.99, 0.9, 20.0
_STRIP = regex.compile(r"^[^\p{L}\p{M}\p{N}#@]+|[^\p{L}\p{M}\p{N}]+$")
_LETTERS = regex.compile(r"^(?=.*\p{L})[\p{L}\p{M}]+$")
_INITIAL = regex.compile(r"^[^\p{L}\p{N}]*[A-Za-z]\.$")
_DEV = regex.compile(r"\p{Devanagari}")
_BLANK = regex.compile(r"(?:\r?\n[^\S\n]*)(?:\r?\n[^\S\n]*)+")


def _places(key: str) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    return h % BUCKETS, BUCKETS + (h >> 32) % BUCKETS


def _letter_groups(w: str) -> list[int]:
    import xxhash

    w = f"^{w}$"
    return [xxhash.xxh32_intdigest(w[i : i + 3]) % GROUPS for i in range(len(w) - 2)]


def allowed(w: str) -> tuple[int, int]:
    """The two languages of the word's script."""
    return (0, 1) if _DEV.search(w) else (2, 3)


class Evidence(dict):
    """Raw tokens to None (does not count) or the log likelihood of the two languages of its script, with these. Shared by
    all batches of a worker."""

    def __init__(self, model: tuple):
        super().__init__()
        self.places, self.counts, self.group_at, self.groups, self.wrong = model
        total = self.groups.sum(0) + 1.0 if len(self.groups) else np.ones(4)
        self.by_group = dict(zip(self.group_at.tolist(), np.log((self.groups + 0.5) / total).tolist()))
        self.no_group = np.log(0.5 / total).tolist()
        self.log_wrong = np.log(self.wrong)
        self.host_priors: dict[str | None, list[float]] = {}

    def count(self, key: str) -> np.ndarray:
        best = None
        for p in _places(key):
            i = int(np.searchsorted(self.places, p))
            c = self.counts[i] if i < len(self.places) and self.places[i] == p else np.zeros(4)
            if best is None or c.sum() < best.sum():
                best = c
        return best

    def prior(self, host: str | None) -> list[float]:
        """Log shares of the languages: host, smoothed towards suffix, towards corpus, towards equal."""
        p = self.host_priors.get(host)
        if p is None:
            share = np.full(4, 0.25)
            for key in ("c:", *((f"s:{host.rsplit('.', 1)[-1]}", f"h:{host}") if host else ())):
                c = self.count(key)
                share = (c + SMOOTH * share) / (c.sum() + SMOOTH)
            if len(self.host_priors) > 100_000:
                self.host_priors.clear()
            p = self.host_priors[host] = np.log(share).tolist()
        return p

    def __missing__(self, token: str):
        t = _STRIP.sub("", plain(token))
        r = None
        if t and t[0] not in "#@" and _LETTERS.match(t):
            s = spelt(token) or spelt(t)
            a, b = allowed(s)
            c = self.count("=" + s)
            if not c[a] + c[b]:
                c = self.count("~" + spoken(s))
            x, y = float(c @ self.log_wrong[a]), float(c @ self.log_wrong[b])
            for g in _letter_groups(s):
                v = self.by_group.get(g, self.no_group)
                x, y = x + 0.5 * v[a], y + 0.5 * v[b]
            r = (a, b, x - y)
        if len(self) > 500_000:
            self.clear()
        self[token] = r
        return r


_models: dict[int, tuple[tuple, Evidence]] = {}


def _evidence(model: tuple) -> Evidence:
    """One for each model in a worker."""
    if id(model) not in _models:
        _models.clear()
        _models[id(model)] = model, Evidence(model)  # the model is kept, so that no other gets its id
    return _models[id(model)][1]


@F.arrow_udf(StringType())
def _spelt(x: pa.Array) -> pa.Array:
    return pa.array([spelt(w) for w in x.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _spoken(x: pa.Array) -> pa.Array:
    return pa.array([spoken(w) for w in x.to_pylist()], pa.string())


def host_of(url: str = "source_url", source: str | None = None) -> F.Column:
    """The host of the address; where there is none, the part of ``source`` behind its slash, or null."""
    h = F.nullif(F.lower(F.regexp_extract(F.col(url), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]+)", 1)), F.lit(""))
    return F.coalesce(h, F.element_at(F.split(F.lower(F.trim(source)), "/"), -1)) if source else h


def _counts(label: str = "label", n: str = "n") -> list[F.Column]:
    return [F.sum(F.when(F.col(label) == l, F.col(n)).otherwise(0)).cast("double").alias(f"n{i}") for i, l in enumerate(LANGS)]


def word_counts(annotated: DataFrame) -> DataFrame:
    """(key, n0..n3): labels of each word as it is spelt (=) and as it is spoken (~), over all tokens."""
    t = annotated.select(F.explode("token_language_labels").alias("t")).where(F.col("t.label").isin(*LANGS))
    t = t.groupBy(F.col("t.token").alias("token"), F.col("t.label").alias("label")).agg(F.count("*").alias("n")).where("token is not null")
    t = t.groupBy(_spelt("token").alias("w"), "label").agg(F.sum("n").alias("n")).where("w <> ''")
    t = t.withColumn("key", F.explode(F.array(F.concat(F.lit("="), "w"), F.concat(F.lit("~"), _spoken("w")))))
    return t.groupBy("key").agg(*_counts())


def host_counts(docs: DataFrame) -> DataFrame:
    """(key, n0..n3): declared languages of each host, suffix and of all documents. Three keys a host and language go
    through the shuffle."""
    g = docs.where(F.col("lang").isin(*LANGS)).groupBy(host_of("source_url", "source").alias("host"), F.col("lang").alias("label")).agg(F.count("*").alias("n"))
    keys = F.array(F.lit("c:"), F.concat(F.lit("s:"), F.element_at(F.split("host", r"\."), -1)), F.concat(F.lit("h:"), "host"))
    return g.withColumn("key", F.explode(keys)).where("key is not null").groupBy("key").agg(*_counts())


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        at = np.array([_places(k) for k in b.column("key").to_pylist()], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(at.T.reshape(-1)), *(pa.concat_arrays([b.column(f"n{i}")] * 2) for i in range(4))], names=["place", "n0", "n1", "n2", "n3"])


def _grouped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter groups of distinct words, each word counted for the language most of its labels say."""
    for b in it:
        n = np.stack([b.column(f"n{i}").to_numpy(zero_copy_only=False) for i in range(4)], 1)
        place, lang = [], []
        for w, c in zip(b.column("key").to_pylist(), n):
            x, y = allowed(w)
            if c[x] + c[y]:
                gs = _letter_groups(w[1:])
                place += gs
                lang += [x if c[x] >= c[y] else y] * len(gs)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(lang, pa.int32())], names=["place", "lang"])


def model(annotated: DataFrame, docs: DataFrame) -> tuple:
    """The evidence as arrays of bounded size: places and counts, letter groups, and the matrix of labels gone wrong."""
    words = cut(word_counts(annotated))
    each = words.unionByName(host_counts(docs)).mapInArrow(_hashed, "place bigint, n0 double, n1 double, n2 double, n3 double")
    t = each.groupBy("place").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4))).toArrow().sort_by("place")
    own = words.where("startswith(key, '=')")
    g = own.mapInArrow(_grouped, "place bigint, lang int").groupBy("place").agg(*(F.count_if(F.col("lang") == i).cast("double").alias(f"n{i}") for i in range(4))).toArrow().sort_by("place")
    stack = lambda x: np.stack([x.column(f"n{i}").to_numpy() for i in range(4)], 1).astype(np.float64) if x.num_rows else np.zeros((0, 4))
    n = F.array(*(F.col(f"n{i}") for i in range(4)))
    best = F.array_position(n, F.array_max(n)) - 1
    seen = own.where("n0 + n1 + n2 + n3 >= 5").groupBy(best.alias("best")).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4))).collect()
    wrong = np.ones((4, 4)) + 99 * np.eye(4)
    for r in seen:
        wrong[r.best] += [r.n0, r.n1, r.n2, r.n3]
    return t.column("place").to_numpy(), stack(t), g.column("place").to_numpy(), stack(g), wrong / wrong.sum(1, keepdims=True)


def private_spans(text: str) -> list[tuple[int, int]]:
    """The places in the given text of its e-mail addresses, street addresses and numbers."""
    p, at = plain_map(text)
    spans = [x.span() for pat in (EMAIL, ADDRESS, IDS, PHONE) for x in pat.finditer(p)] if regex.search(r"\d", p) or MAILED.search(p) else []
    return spans if at is None else [(at[x], at[y - 1] + 1) for x, y in spans]


def _decided(r: tuple, prior: list[float]) -> tuple[int, float]:
    a, b, odds = r
    odds += prior[a] - prior[b]
    p = 1 / (1 + exp(-min(30, abs(odds))))
    return (a, p) if odds >= 0 else (b, p)


def token_units(text: str, e: Evidence, host: str | None) -> Iterator[tuple[int, int, float]]:
    """(place, language, confidence) of the tokens that count. A letter with a full stop before a name in Latin letters
    is the name's initial, and TRL."""
    spans, end, prior = private_spans(text), 0, e.prior(host)
    toks = text.split()
    for k, tok in enumerate(toks):
        if spans:
            start = text.index(tok, end)
            end = start + len(tok)
        r = e[tok]
        if r is None or any(x < end and start < y for x, y in spans):
            continue
        if r[0] == 2 and _INITIAL.match(tok) and k + 1 < len(toks) and toks[k + 1][:1].isupper() and (n := e[toks[k + 1]]) and n[0] == 2 and _decided(n, prior)[0] == 3:
            yield k, 3, 0.9
        else:
            yield (k, *_decided(r, prior))


def text_language(words: list[tuple], e: Evidence, stated: str | None, host: str | None) -> tuple[int, float]:
    """The language of a text from its words' evidence, declared language and host, and its posterior. Languages no word
    can be in do not come into question."""
    prior = e.prior(host)
    score = [0.5 * x for x in prior]
    if stated in LANGS:
        k = LANGS.index(stated)
        score = [s + log(DECLARED if i == k else (1 - DECLARED) / 3) for i, s in enumerate(score)]
    other = (1 - KNOWN) / 3
    sure: Counter = Counter()
    for a, b, odds in words:
        if abs(odds) > 12:
            sure[a if odds > 0 else b] += 1
            continue
        i, p = _decided((a, b, odds), prior)
        j = b if i == a else a
        for l in range(4):
            score[l] += log(p * (KNOWN if l == i else other) + (1 - p) * (KNOWN if l == j else other))
    step = log(KNOWN / other)
    for l, n in sure.items():
        score[l] += n * step
    can = {l for a, b, _ in words for l in (a, b)}
    best = max(sorted(can), key=lambda l: score[l])
    return best, 1 / sum(exp(min(0.0, score[l] - score[best])) for l in range(4))


_SCHEMA = "record_id string, kind string, unit_no int, lang string, confidence double, stated string"
_KINDS = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string())


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], names=["record_id", "kind", "unit_no", "lang", "confidence", "stated"])


def _tokens(it: Iterator[pa.RecordBatch], model: tuple) -> Iterator[pa.RecordBatch]:
    e = _evidence(model)
    for b in it:
        out: list[tuple] = []
        for key, text, labels, host in zip(*(b.column(i).to_pylist() for i in range(4))):
            for k, l, p in token_units(text, e, host) if text else ():
                out.append((key, "token", k, LANGS[l], p, labels[k] if labels and k < len(labels) else None))
        yield _batch(out)


def _blocks(it: Iterator[pa.RecordBatch], model: tuple) -> Iterator[pa.RecordBatch]:
    e = _evidence(model)
    for b in it:
        out: list[tuple] = []
        for key, text, stated, host in zip(*(b.column(i).to_pylist() for i in range(4))):
            all_: list[tuple] = []
            for k, block in enumerate(x for x in _BLANK.split(text or "") if x.strip()):
                words = [r for r in map(e.__getitem__, block.split()) if r]
                if words:
                    all_ += words
                    l, p = text_language(words, e, stated, host)
                    out.append((key, "block", k, LANGS[l], p, stated))
            if all_:
                l, p = text_language(all_, e, stated, host)
                out.append((key, "document", None, LANGS[l], p, stated))
        yield _batch(out)


def units(s: SparkSession, d: str) -> DataFrame:
    """(record_id, kind, unit_no, lang, confidence, stated): tokens of sentences, blocks of documents, and documents
    (without a unit_no)."""
    a, docs = s.read.parquet(f"{d}/annotated_sentences.parquet"), s.read.parquet(f"{d}/documents.parquet")
    m = s.sparkContext.broadcast(model(a, docs))
    tok = a.select("sentence_id", "text", F.transform("token_language_labels", lambda x: x["label"]).alias("labels"), host_of().alias("host")).mapInArrow(lambda it: _tokens(it, m.value), _SCHEMA)
    blocks = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", host_of("source_url", "source").alias("host")).mapInArrow(lambda it: _blocks(it, m.value), _SCHEMA)
    return tok.unionByName(blocks)


def p4_units(s: SparkSession, d: str) -> DataFrame:
    return units(s, d)


def p4_found(s: SparkSession, d: str) -> DataFrame:
    u = units(s, d).where("kind <> 'document' and (stated is null or stated <> lang)")
    return u.select("record_id", "unit_no", "lang").distinct()
