import random

import numpy as np

from corpuskit.llm import abuse
from corpuskit.llm.abuse import features, fit, hashes, p2_found, p2_rates, p2_scores, strongest, training

ANN = "sentence_id string, text string, platform string, toxicity_labels array<string>, score double"
DOC = "doc_id long, text string, source string, h long"


def _corpus(n=1500, seed=1):
    """A twelfth is abusive by one of four phrases; a tenth of those has no label, and a hundredth of the rest has one."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(300)]
    phrases = ["get lost you nikamma", "go away filthy kutta", "you vile haramkhor", "tujhe peetunga kal"]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(12)]
        bad = rng.random() < 1 / 12
        if bad:
            t[4:4] = rng.choice(phrases).split()
        rows.append((str(i), " ".join(t), bad, rng.random() < (0.9 if bad else 0.01)))
    return rows


def test_prior_and_hidden_share_are_estimated():
    rows = _corpus(6000)
    P, U = [t for _, t, _, l in rows if l], [t for _, t, _, l in rows if not l]
    w, b, prior, hidden = fit(P, U)
    truth, missed = np.mean([x for _, _, x, _ in rows]), np.mean([x for _, _, x, l in rows if not l])
    assert abs(prior - truth) < 0.02 and abs(hidden - missed) < 0.01 and abs(b - np.log(prior / (1 - prior))) < 1e-6
    new = _corpus(1500, 2)
    got = np.array([strongest(features(hashes(t)), w)[0] + b > 0 for _, t, _, _ in new])
    true = np.array([x for _, _, x, _ in new])
    assert (got & true).sum() / true.sum() > 0.98 and (got & true).sum() / max(1, got.sum()) > 0.98


def test_spellings_are_folded():
    assert (hashes("get LOST you n1kamma") == hashes("g-e-t looost you nikamma.")).all() and (hashes("k u t t a") == hashes("kutta")).all()
    assert len(hashes(None)) == len(hashes("")) == 0 and strongest(features(hashes("")), np.ones(1 << abuse.BITS, np.float32)) == (0.0, 0)


def test_records_of_both_tables(spark, tmp_path, monkeypatch):
    rows = [("s" + i, t, "twitter", ["general"] if l else None, 0.5) for i, t, _, l in _corpus()] + [("n", None, None, None, 0.0), ("e", "", " X ", [], 0.0)]
    a = spark.createDataFrame(rows + rows[:3], ANN)
    a.write.parquet(f"{tmp_path}/annotated_sentences.parquet")
    long = " ".join(t for _, t, x, _ in _corpus(200, 3) if not x)
    docs = [(1, long, "blog", 1), (2, long + " go away filthy kutta " + long, "blog", 1), (3, None, None, 1)]
    spark.createDataFrame(docs, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    found = {r.record_id for r in p2_found(spark, d).collect()}
    bad = {"s" + i for i, _, x, _ in _corpus() if x}
    assert len((found - {"2"}) ^ bad) <= 2 and "2" in found and not {"1", "3", "n", "e"} & found
    assert p2_scores(spark, d).count() == len(rows) + 3 + 3
    assert sum(r.records for r in p2_rates(spark, d).collect()) == len(rows) + 6
    monkeypatch.setattr(abuse, "MOST_POSITIVE", 20)
    monkeypatch.setattr(abuse, "MOST_UNLABELLED", 300)
    P, U, share = training(a)
    assert len(P) == 20 and 280 < len(U) <= 300 and 0.05 < share < 0.12
    assert fit([], ["x"])[1] < -10 and training(a.limit(0)) == ([], [], 0.0)
