import random

import numpy as np
from pyspark.sql import functions as F

from corpuskit.llm import votes
from corpuskit.llm.votes import agreement, answers, consensus, joined_answers, maximise, p3_units, reliability, units

SPAN = "struct<start int, end int, entity_type string, text string>"
ANN = f"sentence_id string, sentiment_annotator_labels array<string>, toxicity_annotator_labels array<array<string>>, ner_annotator_spans array<array<{SPAN}>>, item string, kind int"


def tables(spark, d, sent, tox, spans, gold, ann=()):
    spark.createDataFrame(sent, "batch_id string, item_id string, annotator int, label string").write.parquet(f"{d}/sentiment_votes.parquet")
    spark.createDataFrame(tox, "batch_id string, item_id string, annotator int, labels array<string>").write.parquet(f"{d}/tox_votes.parquet")
    spark.createDataFrame(spans, "batch_id string, item_id string, annotator int, start int, end int, entity_type string").write.parquet(f"{d}/span_votes.parquet")
    spark.createDataFrame(gold, f"sentence_id string, sentiment string, toxicity_labels array<string>, ner_spans array<{SPAN}>").write.parquet(f"{d}/adjudicated_items.parquet")
    spark.createDataFrame([(*a, "x", 1) for a in ann], ANN).write.parquet(f"{d}/annotated_sentences.parquet")
    return str(d)


def _small(spark, d, ann=()):
    labels = {"i": ("positive", "positive"), "j": ("negative", "neutral"), "k": ("neutral", "neutral")}
    sent = [("b", i, a, ls[a - 1]) for i, ls in labels.items() for a in (1, 2)]
    tox = [("b", i, a, ["general"] if (i, a) == ("i", 1) else []) for i in labels for a in (1, 2)]
    spans = [("b", "i", 1, 0, 3, "PER"), ("b", "i", 2, 0, 3, "PER")]
    gold = [("i", "positive", [], [(0, 3, "PER", "abc"), (5, 8, "LOC", "def")]), ("j", "negative", [], [(1, 2, "ORG", "x")]), ("unjudged", "neutral", [], [(1, 2, "ORG", "x")])]
    return tables(spark, d, sent, tox, spans, gold, ann)


def test_adjudicated_spans_nobody_marked_count(spark, tmp_path):
    d = _small(spark, tmp_path)
    con = p3_units(spark, d).where("task = 'ner'")
    assert sorted(tuple(r) for r in con.collect()) == [("ner", "i", "0|3|PER", "yes", 1.0), ("ner", "i", "5|8|LOC", "yes", 1.0), ("ner", "j", "1|2|ORG", "yes", 1.0)]
    rel = reliability(spark, d).where("task = 'ner'")
    assert sorted(tuple(r) for r in rel.collect()) == [(1, "ner", 3, 1), (2, "ner", 3, 1)]


def test_agreement_is_cohens_kappa(spark, tmp_path):
    got = {r.task: (round(r.kappa, 6), r.pairs, r.votes) for r in agreement(spark, _small(spark, tmp_path)).collect()}
    assert got == {"sentiment": (0.5, 1, 3), "toxicity": (0.75, 4, 12), "ner": (1.0, 1, 1)}


def test_one_row_a_sentence_and_arrays(spark, tmp_path):
    ann = [("k", ["negative", "negative"], None, [[(0, 1, "LOC", "x")], None]), ("new", ["Positive ", "positive", None], [["general"]] * 3, [[(2, 4, "PER", "y")]] * 3), ("none", None, None, None)]
    d = _small(spark, tmp_path, ann)
    got = {r.sentence_id: r for r in consensus(spark, d).collect()}
    assert set(got) == {"i", "j", "k", "new"}
    assert got["i"].sentiment == "positive" and got["i"].toxicity_labels == [] and [tuple(p) for p in got["i"].ner_spans] == [(0, 3, "PER"), (5, 8, "LOC")]
    assert got["k"].sentiment == "neutral"
    assert got["new"].sentiment == "positive" and got["new"].toxicity_labels == ["general"] and [tuple(p) for p in got["new"].ner_spans] == [(2, 4, "PER")]
    assert {r.annotator for r in reliability(spark, d).collect()} == {1, 2}


def test_empty_tables(spark, tmp_path):
    d = tables(spark, tmp_path, [], [], [], [])
    assert consensus(spark, d).count() == reliability(spark, d).count() == agreement(spark, d).count() == 0


def _noisy(spark, d, n=300):
    """Annotator 1 judges all items, 4 is wrong in four of five cases, 5 reverses toxicity."""
    rng = random.Random(4)
    sent, tox, spans = [], [], []
    truth = {}
    for i in range(n):
        t = rng.choice(votes.SENTIMENTS)
        x = [c for c in votes.CATEGORIES if rng.random() < 0.2]
        truth[str(i)] = (t, x)
        for a in (1, *rng.sample((2, 3, 4, 5), 3)):
            good = rng.random() < (0.2 if a == 4 else 0.85)
            sent += [("b", str(i), a, t if good else rng.choice([s for s in votes.SENTIMENTS if s != t]))] * rng.choice((1, 2))
            sent.append(("b", str(i), a, None))
            tox.append(("b", str(i), a, [c for c in votes.CATEGORIES if (c in x) != (a == 5 or rng.random() < 0.05)] or ["none"]))
            if i % 2 and rng.random() < 0.9:
                spans.append(("b", str(i), a, 0, 4, "PER"))
    gold = [(str(i), truth[str(i)][0], truth[str(i)][1], []) for i in range(0, 40)]
    return tables(spark, d, sent, tox, spans, gold), truth


def test_bad_annotators_and_labels_are_recovered(spark, tmp_path):
    d, truth = _noisy(spark, tmp_path)
    r = {(x.annotator, x.task): x.right / x["items"] for x in reliability(spark, d).collect()}
    assert {k for k, v in r.items() if v < 0.5 and k[1] != "ner"} == {(4, "sentiment"), (5, "toxicity")}
    got = {x.sentence_id: x for x in consensus(spark, d).collect()}
    assert sum(got[k].sentiment == t for k, (t, _) in truth.items()) / len(truth) > 0.9
    assert sum(got[k].toxicity_labels == sorted(x) for k, (_, x) in truth.items()) / len(truth) > 0.9
    assert all(got[str(i)].sentiment == truth[str(i)][0] and got[str(i)].sentiment_p == 1 for i in range(40))


def test_likelihood_rises_and_joins_agree(spark, tmp_path, monkeypatch):
    d, _ = _noisy(spark, tmp_path, 120)
    u = units(spark, d)
    likes = votes.fitted(u)[3]
    assert len(likes) < votes.MOST_ROUNDS and all(b >= a - 1e-6 * abs(a) for a, b in zip(likes[1:], likes[2:]))
    monkeypatch.setattr(votes, "MOST_ROUNDS", 3)
    monkeypatch.setattr(votes, "ENOUGH", -1.0)
    key = lambda r: (r.task, r["item"], r["sub"])
    a = {key(r): r for r in answers(spark, d)[0].collect()}
    b = {key(r): r for r in joined_answers(u, 3).collect()}
    assert a.keys() == b.keys()
    for k, x in a.items():
        y = b[k]
        assert x.label == y.label and abs(x.p - y.p) < 1e-9 and sorted(zip(x.who, x.right)) == sorted(zip(y.who, y.right)), k


def test_matrices_are_smoothed_shares():
    sums = np.zeros(votes.CELLS + 8)
    sums[:9] = [2, 0, 0, 0, 0, 0, 0, 0, 1]
    conf, prior = maximise(sums, 1)
    assert np.allclose(np.exp(conf[0, :3]), [6 / 8, 1 / 8, 1 / 8]) and np.allclose(np.exp(conf[0, 3:6]), [1 / 6, 4 / 6, 1 / 6]) and np.allclose(np.exp(prior[3:5]), 0.5)


def _settled(item, who, said):
    """Posteriors of the sentiments by the method's definition, on arrays of all votes, and the number of rounds."""
    n, m = item.max() + 1, who.max() + 1
    z = np.zeros((n, 3))
    np.add.at(z, (item, said), 1.0)
    p, likes = z / z.sum(1, keepdims=True), [0.0]
    while True:
        c = np.zeros((m, 3, 3))
        for t in range(3):
            np.add.at(c, (who, t, said), p[item, t])
        conf = np.log((c + votes.SMOOTH + votes.TRUST * np.eye(3)) / (c.sum(2, keepdims=True) + 3 * votes.SMOOTH + votes.TRUST))
        z = np.tile(np.log((p.sum(0) + 1) / (n + 3)), (n, 1))
        for t in range(3):
            np.add.at(z[:, t], item, conf[who, t, said])
        if len(likes) > 2 and likes[-1] - likes[-2] < votes.ENOUGH * abs(likes[-2]):
            x = np.exp(z - z.max(1, keepdims=True))
            return x / x.sum(1, keepdims=True), len(likes)
        x = np.exp(z - z.max(1, keepdims=True))
        p = x / x.sum(1, keepdims=True)
        likes.append(float((z.max(1) + np.log(x.sum(1))).sum()))


def test_very_many_annotators_take_the_same_rounds(spark, tmp_path):
    """100 020 annotators, most of whom judge one item only."""
    rng = np.random.default_rng(7)
    truth = rng.integers(0, 3, 52_000)
    item = np.concatenate([np.repeat(np.arange(2000), 5), np.repeat(np.arange(2000, 52_000), 3)])
    few = np.concatenate([rng.permutation(20)[:5] for _ in range(2000)])
    many = np.stack([np.arange(50_000) % 20, 20 + np.arange(50_000), 50_020 + np.arange(50_000)], 1).ravel()
    who = np.concatenate([few, many])
    good = rng.random(len(item)) < np.where(who < 5, 0.0, 0.9)
    said = np.where(good, truth[item], rng.integers(0, 3, len(item)))
    p, rounds = _settled(item, who, said)
    assert rounds > 8
    sent = [("b", str(i), int(a), votes.SENTIMENTS[x]) for i, a, x in zip(item, who, said)]
    got = answers(spark, tables(spark, tmp_path, sent, [], [], []))[0].select("item", "label", "p", F.size("who").alias("n")).toArrow().to_pylist()
    assert len(got) == len(p) and sum(r["n"] for r in got) == len(item)
    for r in got:
        own = p[int(r["item"])]
        assert abs(r["p"] - own.max()) < 1e-9 and own[votes.SENTIMENTS.index(r["label"])] > own.max() - 1e-9, r
