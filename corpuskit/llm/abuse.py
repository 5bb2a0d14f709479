"""Problem 2: score every record for abusive, hateful or sexually explicit language.

Method: non-negative positive-unlabelled learning. A numpy logistic model over hashed one- to three-word groups is fitted
to labelled toxic sentences and unlabelled ones with the class-prior-corrected risk (see ``fit``), whose negative part is
kept from going below zero; class prior and hidden positives are estimated from the data, the bias is the log odds of
the prior. Texts enter by the stretch of ``SPAN`` words that differs most between the two sets, and by the word groups
that tell them apart. A record's score is its strongest stretch, so a phrase in a long document counts as in a short post.

The classifier is fitted on at most ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` sentences chosen by hash; every record is
scored whole. Cases: null and empty texts score the bias, lowered to that of a rare class, and are not found; spaced,
dotted, repeated and digit-for-letter spellings are folded first; repeated rows give one finding; without positives every
score is zero; null labels are no labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.canon import spoken

MOST_POSITIVE, MOST_UNLABELLED = 8_000, 24_000
SPAN, BITS = 9, 19
_SIZE = 1 << BITS


class Ids(dict):
    def __missing__(self, token: str) -> int:
        import xxhash

        s = spoken(token)
        v = (xxhash.xxh64_intdigest(s) >> 2) if s else 0
        if len(self) > 400_000:
            self.clear()
        self[token] = v
        return v


_ids = Ids()


def _short(t: str) -> bool:
    return sum(c.isalpha() for c in t) == 1 and len(t) <= 3


def hashes(text: str | None) -> np.ndarray:
    """Word hashes; runs of three or more single letters are read as one word."""
    toks = (text or "").split()
    if len(toks) > 2 and any(map(_short, toks)):
        out, run = [], []
        for t in [*toks, "  "]:
            if _short(t):
                run.append(t)
                continue
            out += ["".join(run)] if len(run) > 2 else run
            run = []
            out.append(t)
        toks = out[:-1]
    v = np.fromiter((_ids[t] for t in toks), np.int64, len(toks))
    return v[v != 0]


def features(h: np.ndarray) -> np.ndarray:
    """(3, n): the places in the weight table of the groups that start at each word; the last of a text wrap to 0."""
    f = np.zeros((3, len(h)), np.int64)
    with np.errstate(over="ignore"):
        f[0] = (h * np.int64(0x5851F42D4C957F2D) >> 24) % (_SIZE - 1) + 1
        if len(h) > 1:
            g = h[:-1] * np.int64(1_000_003) + h[1:]
            f[1, :-1] = (g * np.int64(0x5851F42D4C957F2D) >> 24) % (_SIZE - 1) + 1
        if len(h) > 2:
            g = g[:-1] * np.int64(1_000_033) + h[2:]
            f[2, :-2] = (g * np.int64(0x5851F42D4C957F2D) >> 24) % (_SIZE - 1) + 1
    return f


def strongest(f: np.ndarray, w: np.ndarray) -> tuple[float, int]:
    """The greatest sum over a stretch of SPAN words, and where it starts."""
    if not f.shape[1]:
        return 0.0, 0
    s = np.concatenate([[0.0], np.cumsum(w[f].sum(0))])
    win = s[np.minimum(np.arange(f.shape[1]) + SPAN, f.shape[1])] - s[:-1]
    i = int(win.argmax())
    return float(win[i]), i


def fit(positive: list[str], unlabelled: list[str], labelled_share: float | None = None, rounds: int = 2, epochs: int = 24) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, class prior and hidden share.

    The risk is pi R_p(+) + max(0, R_u(-) - h R_p(-)): pi the share of positives in all, h their share among the rows not
    labelled so. Both are estimated: the first fit takes labels at their word (pi the labelled share, h 0); then h is the
    share of unlabelled rows the fit finds, pi the labelled share without the labelled rows that it finds nothing in,
    plus h; and the fit is done again. A stretch without any telling group says nothing, so its score is pi: the bias is
    the log odds of pi.
    """
    if not positive or not unlabelled:
        return np.zeros(_SIZE, np.float32), -20.0, 0.0, 0.0
    P, U = [features(hashes(t)) for t in positive], [features(hashes(t)) for t in unlabelled]
    share = labelled_share if labelled_share is not None else len(P) / (len(P) + len(U))
    prior, hidden = share, 0.0
    for k in range(rounds):
        bias = float(np.log(prior / (1 - prior)))
        w = _fit(P, U, bias, prior, hidden, epochs)
        if k + 1 < rounds:
            hidden = float(np.mean([strongest(x, w)[0] + bias > 0 for x in U]))
            sure = float(np.mean([strongest(x, w)[0] + bias > 0 for x in P]))
            prior = min(0.5, max(1e-4, share * sure + (1 - share) * hidden))
    return w, bias, prior, hidden


def _fit(P: list[np.ndarray], U: list[np.ndarray], b: float, prior: float, hidden: float, epochs: int) -> np.ndarray:
    w = np.zeros(_SIZE, np.float32)
    rng = np.random.default_rng(42)
    def counts(fs: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate([np.unique(x) for x in fs]), minlength=_SIZE)

    def sure(cp: np.ndarray, cu: np.ndarray) -> np.ndarray:
        """More often in positives than four times the chance and its spread."""
        e = (cu + 0.1) * len(P) / n_all
        return cp >= 4 * e + 4 * np.sqrt(e + 0.3) + 2

    def lift(fs: list[np.ndarray], us: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cp, cu = counts(fs), counts(us)
        return cp, cu, (cp + 0.1) / len(fs) / ((cu + 0.5) / n_all)

    n_all = len(U)
    cp, cu, ratio = lift(P, U)
    seed = np.where(sure(cp, cu), np.log(ratio), 0).astype(np.float32)
    seed[0] = 0
    P = [x[:, (i := strongest(x, seed)[1]) : i + SPAN] for x in P]
    hot = [x[:, (r := strongest(x, seed))[1] : r[1] + SPAN] for x in U if strongest(x, seed)[0] > 0]
    U = hot or U
    cp, cu, ratio = lift(P, U)
    mask = (seed > 0) | ((cu >= 3) & (ratio < 0.3))
    mask[0] = False
    scale = len(U) / n_all
    g2 = np.full(_SIZE, 1e-6, np.float32)
    n_p, n_u = len(P), len(U)
    for _ in range(epochs):
        op, ou = rng.permutation(n_p), rng.permutation(n_u)
        for k in range(steps := max(1, n_u // 1000)):
            bp, bu = op[k * n_p // steps : (k + 1) * n_p // steps], ou[k * n_u // steps : (k + 1) * n_u // steps]
            if not len(bp) or not len(bu):
                continue
            sets = [np.unique(P[i]) for i in bp] + [np.unique(U[i]) for i in bu]
            idx = np.concatenate(sets)
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            z = np.bincount(row, w[idx] * (idx > 0), len(sets)) + b
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            m = len(bp)
            soft = np.logaddexp(0, z)
            negative = scale * soft[m:].mean() - hidden * soft[:m].mean()
            g = np.empty(len(sets))
            if negative >= 0:
                g[:m] = (prior * (p[:m] - 1) - hidden * p[:m]) / m
                g[m:] = scale * p[m:] / (len(sets) - m)
            else:
                g[:m] = (prior * (p[:m] - 1) + hidden * p[:m]) / m
                g[m:] = -scale * p[m:] / (len(sets) - m)
            g *= 10
            grad = np.bincount(idx, g[row] * (idx > 0), _SIZE).astype(np.float32) + 2e-5 * w
            grad *= mask
            g2 += grad * grad
            w -= 0.25 * grad / np.sqrt(g2)
    w[0] = 0
    return w


def training(annotated: DataFrame) -> tuple[list[str], list[str], float]:
    """Rows to fit on, and the share of labelled rows in all. A row's hash places it; only hashes below the bound that
    lets about as many rows through as are wanted reach the sort, so that no task sends more than its part."""
    a = annotated.where("text is not null").select("text", (F.coalesce(F.size("toxicity_labels"), F.lit(0)) > 0).alias("toxic"), F.xxhash64("sentence_id").alias("h"))
    n = a.agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u")).first()

    def chosen(rows: DataFrame, there: int, most: int) -> list[str]:
        part = min(1.0, (most + 5 * most**0.5) / max(there, 1))
        return [r.text for r in rows.where(F.col("h") <= int(-(2**63) + part * (2**64 - 1025))).orderBy("h", "text").limit(most).collect()]

    return chosen(a.where("toxic"), n.p, MOST_POSITIVE), chosen(a.where(~F.col("toxic")), n.u, MOST_UNLABELLED), n.p / max(1, n.p + n.u)


def _score(it: Iterator[pa.RecordBatch], w: np.ndarray, b: float) -> Iterator[pa.RecordBatch]:
    for batch in it:
        z = [strongest(features(hashes(t)), w)[0] + b if t else min(b, -1.0) for t in batch.column("text").to_pylist()]
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(score, pa.float64())], names=[*rest, "score"])


def scores(s: SparkSession, d: str) -> DataFrame:
    """(record_id, source, score) of every record of both tables."""
    a, docs = s.read.parquet(f"{d}/annotated_sentences.parquet"), s.read.parquet(f"{d}/documents.parquet")
    w, b, _, _ = fit(*training(a))
    model = s.sparkContext.broadcast((w, b))
    rec = a.select(F.col("sentence_id").alias("record_id"), F.lower(F.trim("platform")).alias("source"), "text")
    rec = rec.unionByName(docs.select(F.col("doc_id").cast("string").alias("record_id"), "source", "text"))
    return rec.mapInArrow(lambda it: _score(it, *model.value), "record_id string, source string, score double")


def p2_scores(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d)


def p2_rates(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.col("score") > 0.5).alias("toxic"), F.avg((F.col("score") > 0.5).cast("double")).alias("rate"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).where("score > 0.5").select("record_id").distinct()
