import random

import pytest

from corpuskit.llm.mix import BLOCK, block_pieces, mixture, plan, report, slots
from corpuskit.llm.quota import feasible
from corpuskit.llm.sample import reservoirs

ANN = "sentence_id string, platform string, sentiment string, priority int, seen string"
TARGET = "platform string, sentiment string, target_share double, min_rows int, sample_fraction double"


def test_feasible_quotas():
    assert feasible(100, [1, 1, 2], [0, 0, 0], [1000] * 3) == [25, 25, 50]
    assert feasible(100, [1, 1, 2], [0, 0, 0], [1000, 1000, 10]) == [45, 45, 10]
    assert feasible(100, [1, 1, 0], [0, 0, 7], [1000] * 3) == [47, 46, 7]
    assert feasible(100, [1, 1], [0, 0], [3, 4]) == [3, 4] and feasible(0, [1, 0], [2, 0], [5, 5]) == [2, 0] and feasible(5, [], [], []) == []
    assert feasible(10, [0.0, 0.0], [0, 0], [5, 9]) in ([5, 5], [0, 0])
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        s, f, c = [rng.random() for _ in range(n)], [rng.randint(0, 5) for _ in range(n)], [rng.randint(0, 200) for _ in range(n)]
        t = rng.randint(0, 900)
        q = feasible(t, s, f, c)
        assert all(min(a, b) <= x <= b for x, a, b in zip(q, f, c)) and sum(q) == min(max(t, sum(min(a, b) for a, b in zip(f, c))), sum(c))


def _rows(spark, n=5000):
    rng = random.Random(2)
    rows = [(f"id{i}", rng.choice((" Twitter", "twitter", "manual")) if i % 9 else "rare", rng.choice(("positive", "neutral")) if i % 9 else "positive", 1, "x") for i in range(n)]
    return rows, rows + rows[:500] + [("null1", None, "positive", 1, "x"), ("null2", "twitter", None, 1, "x"), (None, "twitter", "positive", 1, "x"), ("two", "zzz", "positive", 1, "x"), ("two", "manual", "neutral", 1, "x")]


def test_sample_follows_the_targets(spark):
    rows, dirty = _rows(spark)
    t = spark.createDataFrame([("twitter", "positive", 0.3, 5, 0.3), ("twitter", "neutral", 0.2, 5, 0.3), ("manual", "positive", 0.01, 30, 0.3), ("rare", "positive", 0.49, 5, 0.3), ("absent", "neutral", 0.0, 5, 0.3)], TARGET)
    sample, rep = reservoirs(spark.createDataFrame(dirty, ANN).repartition(7), t)
    got, r = sample.collect(), {(x.platform, x.sentiment): x for x in rep.collect()}
    assert len({x.sentence_id for x in got}) == len(got) == round(0.3 * 5001)
    rare = sum(p == "rare" for _, p, *_ in rows)
    assert r["rare", "positive"].taken == rare and r["rare", "positive"].exhausted and abs(r["rare", "positive"].unmet - (0.49 * 0.3 * 5001 - rare)) < 1e-6
    assert r["manual", "positive"].taken == 30 and r["absent", "neutral"].taken == 0 and not r["absent", "neutral"].exhausted
    assert abs(r["twitter", "positive"].taken / r["twitter", "neutral"].taken - 1.5) < 0.02 and abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    assert {x.sentence_id for x in got} == {x.sentence_id for x in reservoirs(spark.createDataFrame(dirty, ANN).coalesce(1), t)[0].collect()}
    sample, rep = reservoirs(spark.createDataFrame([], ANN), t)
    assert sample.count() == 0 and rep.agg({"taken": "sum"}).first()[0] == 0


def test_the_least_priorities_are_taken(spark):
    import hashlib

    rows, dirty = _rows(spark, 3000)
    t = spark.createDataFrame([("twitter", "positive", 1.0, 0, 0.1)], TARGET)
    got = {x.sentence_id for x in reservoirs(spark.createDataFrame(dirty, ANN), t)[0].collect()}
    own = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest()[:15], i) for i, p, s, *_ in rows if p.strip().lower() == "twitter" and s == "positive")
    assert len(got) == 300 and got == {i for _, i in own[:300]}


DOC = "doc_id long, source string, n_tokens long"
MIX = "source string, target_share double, max_repeats int"


def _sizes(spark):
    rng = random.Random(3)
    rows = [(i, "big", rng.randint(0, 5000)) for i in range(400)] + [(1000 + i, "mid", 700) for i in range(300)] + [(2000 + i, "small", 300) for i in range(30)] + [(3000, "none", 0)]
    return spark.createDataFrame(rows, DOC)


def test_blocks_are_equal_and_cover_every_token(spark):
    d = _sizes(spark)
    b = block_pieces(d).collect()
    size, parts = {}, {}
    for r in b:
        size[r.source, r.block] = size.get((r.source, r.block), 0) + r.tokens
        parts.setdefault(r.doc_id, []).append((r.from_token, r.tokens))
    last = {s: max(k for t, k in size if t == s) for s in ("big", "mid", "small")}
    assert all(v == BLOCK for (s, k), v in size.items() if k < last[s])
    for r in d.collect():
        at = 0
        for a, n in sorted(parts.get(r.doc_id, [])):
            assert a == at and n > 0
            at += n
        assert at == r.n_tokens


def test_mixture_meets_the_targets(spark):
    d = _sizes(spark)
    t = spark.createDataFrame([("big", 0.3, 2), ("mid", 0.5, 5), ("small", 0.2, 2), ("none", 0.0, 2), ("absent", 0.0, 1)], MIX)
    p = plan(d, t)
    r = {x.source: x for x in report(d, p).collect()}
    total = sum(x.own for x in r.values())
    assert r["small"].exhausted and r["small"].used == 2 * 9000 and abs(r["small"].unmet - (0.2 * total - 18000)) < 1e-6
    assert r["mid"].repeats <= 5 and r["none"].used == r["absent"].used == 0
    for a, x in (("big", 0.3), ("mid", 0.5)):
        assert abs(r[a].used - x / 0.8 * (total - 18000)) <= 2 * BLOCK
    s = [x.source for x in slots(spark, p).orderBy("slot").collect()]
    big = [i for i, x in enumerate(s) if x == "big"]
    gaps = [b - a for a, b in zip(big, big[1:])]
    assert max(gaps[: len(gaps) // 2]) <= 6
    m = mixture(d, p).groupBy("source", "slot").sum("tokens").collect()
    assert len({(x.source, x.slot) for x in m}) == sum(q["slots"] for q in p)


def test_empty_sources_and_wrong_targets(spark):
    d = _sizes(spark).limit(0)
    t = spark.createDataFrame([("big", 1.0, 2)], MIX)
    assert [(x.used, x.exhausted) for x in report(d, plan(d, t)).collect()] == [(0, False)]
    with pytest.raises(ValueError):
        plan(d, t.union(t))
