import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import agreement, annotation, dedup, filters, metrics, ranks, reports, sampling, taggers, training, validate, welfare

SPACES = [chr(c) for c in range(0x10000) if chr(c).isspace()]


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr("x").alias("y")).first().y


def test_text_by_unicode_white_space(spark):
    text = "".join(f"a{i}{c}" for i, c in enumerate(SPACES))
    assert one(spark, text, "string", T.tokens) == text.split()
    assert one(spark, SPACES[3] + " ab " + SPACES[-1], "string", T.strip) == "ab"
    got = one(spark, "  😀 ab ab\tc ", "string", T.token_places)
    assert [(r.token, r.start, r.end) for r in got] == [("😀", 2, 3), ("ab", 4, 6), ("ab", 7, 9), ("c", 10, 11)]
    assert one(spark, "", "string", T.tokens) == [] and one(spark, None, "string", T.tokens) is None


def test_shingles_scripts_and_places(spark):
    assert [len(one(spark, "abcd"[:n], "string", T.shingles)) for n in range(5)] == [0, 0, 0, 1, 2]
    assert one(spark, "ababab", "string", T.shingles) == ["aba", "bab"]
    assert [one(spark, t, "string", T.script) for t in ("कab", "कa", "abक", "12")] == ["latin", "devanagari", "latin", "other"]
    for a, b in ((0, 2), (-3, -1), (2, 1), (-9, 2), (1, 99)):
        got = spark.createDataFrame([("पqrst", a, b)], "t string, a int, b int").select(T.cut_text("t", F.col("a"), F.col("b")).alias("y")).first().y
        assert got == "पqrst"[a:b]
    assert one(spark, "é", "string", T.nfc) == "é"
    assert [str(one(spark, t, "string", T.parse_time)) for t in (None, "", "2024-01-15T10:30:00Z", "2024-01-15T12:30:00+02:00")] == ["1970-01-01 00:00:00"] * 2 + ["2024-01-15 10:30:00"] * 2


def test_lexicon_filter_inline_and_joined_agree(spark):
    words = ["म्हारो", "थारो", "कोनी"]
    rows = [(1, "म्हारो थारो x"), (2, "म्हारो म्हारो"), (3, "कोनी"), (4, None), (5, ""), (6, "KONI कोनी, थारो")]
    df = spark.createDataFrame(rows, "seq long, text string")
    lines = spark.createDataFrame([(w,) for w in ["# x", " ", *words, *words]], "value string")
    frame = filters.lexicon_frame(lines)
    assert frame.count() == 3
    for least, want in ((2, [1, 2]), (1, [1, 2, 3, 6]), (0, [1, 2, 3, 4, 5, 6])):
        assert sorted(r.seq for r in filters.lexicon_filter(df, words, least).collect()) == want
        assert sorted(r.seq for r in filters.lexicon_filter(df, frame, least).collect()) == want
    assert filters.lexicon_filter(df, []).count() == 0


def test_manual_records_and_gate(spark):
    rows = [("  exactly10 ", "", "WhatsApp "), ("nine char", "u", "sharechat"), ("0123456789", None, None), ("long enough text", "u", "SHARECHAT"), (None, "u", "news")]
    got = filters.manual_records(spark.createDataFrame(rows, "text string, source_url string, platform string")).collect()
    assert [tuple(r) for r in got] == [("0123456789", "manual://other", "twitter"), ("long enough text", "u", "sharechat")]
    scores = spark.createDataFrame([("sentiment", 0.85), ("ner", float("nan"))], "task string, macro_f1 double")
    assert {r.task: r.passed for r in filters.release_gate(scores, {"sentiment": 0.85, "ner": 0.1, "toxicity": 0.1}).collect()} == {"sentiment": True, "ner": False, "toxicity": False}


def _greedy(rows, percent=85):
    kept = []
    grams = {s: {t[i : i + 3] for i in range(len(t) - 2)} for s, t in rows}
    for s, _ in sorted(rows):
        if not any(grams[s] and grams[k] and 100 * len(grams[s] & grams[k]) >= percent * len(grams[s] | grams[k]) for k in kept):
            kept.append(s)
    return kept


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 60))) for _ in range(25)]
    rows = []
    for i in range(160):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            if t:
                p = rng.randrange(len(t))
                t = t[:p] + rng.choice("abcdef ") + t[p + 1 :]
        rows.append((i, t))
    rows += [(200, ""), (201, "ab"), (202, "ab")]
    df = spark.createDataFrame([(*r, "clash") for r in rows] + [(300, None, "clash")], "seq long, text string, grams string")
    grams = {s: {t[i : i + 3] for i in range(len(t) - 2)} for s, t in rows}
    want = {(a, b) for a in grams for b in grams if a < b and grams[a] and 100 * len(grams[a] & grams[b]) >= 85 * len(grams[a] | grams[b])}
    assert {(r.a, r.b) for r in dedup.near_pairs(df).collect()} == want
    assert sorted(r.seq for r in dedup.greedy_keep(df).collect()) == _greedy(rows)
    assert dedup.greedy_keep(df.limit(0)).count() == 0


def test_count_table_is_dense_and_capped(spark):
    from corpuskit.operators.counts import count_table

    df = spark.createDataFrame([(0, 2), (5000, 70_000), (9999, 1), (0, 3)], "bucket int, n long")
    t = count_table(df, 10_000)
    assert len(t) == 10_000 and t[0] == 5 and t[5000] == 65535 and t[9999] == 1 and t.astype(int).sum() == 65541
    assert count_table(df.limit(0), 10).tolist() == [0] * 10


def test_banded_pairs_are_true_ones(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(120)) for _ in range(60)]
    rows = [(2 * i, t) for i, t in enumerate(base)] + [(2 * i + 1, t[:60] + "#" + t[61:]) for i, t in enumerate(base)]
    _, classes = dedup.gram_classes(spark.createDataFrame(rows, "seq long, text string"))
    exact = {(r.ca, r.cb) for r in dedup.class_pairs(classes).collect()}
    some = {(r.ca, r.cb) for r in dedup.class_pairs(classes, banded=True).collect()}
    assert len(exact) == 60 and some <= exact and len(some) > 50


def test_greedy_keeps_both_ends_of_a_chain(spark):
    t = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = [(1, t), (2, t[:-2] + "12"), (3, t[:-4] + "3412")]
    df = spark.createDataFrame(rows, "seq long, text string")
    assert sorted(r.seq for r in dedup.greedy_keep(df, percent=88).collect()) == _greedy(rows, 88) == [1, 3]
    words = "The quick brown fox jumps over the lazy dog near the river"
    assert dedup.greedy_keep(spark.createDataFrame([(1, words + " bank"), (2, words + " today again")], "seq long, text string")).count() == 2


def test_merge_takes_earlier_files_first(spark):
    a = spark.createDataFrame([(5, "x", "a5"), (1, "y", "a1")], "seq long, sentence_id string, text string")
    b = spark.createDataFrame([(0, "x", "b0"), (0, "z", "b1"), (1, "z", "b2"), (0, None, "b3")], "seq long, sentence_id string, text string")
    assert sorted(r.text for r in dedup.merge_first([a, b]).collect()) == ["a1", "a5", "b1"]


def test_ranks_equal_a_window(spark):
    df = spark.createDataFrame([(f"k{i}", "a" if i % 3 else None) for i in range(500)], "key string, g string").withColumn("h", ranks.hashed("key"))
    got = ranks.ranked(df, "g", F.col("h"), "key").collect()
    for g in ("a", None):
        own = sorted((r.h, r.key) for r in got if r.g == g)
        assert [r.key for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == [k for _, k in own]
        assert {r["rank"] for r in got if r.g == g} == set(range(1, len(own) + 1)) and {r.group_rows for r in got if r.g == g} == {len(own)}


def _pool(spark, a, b):
    return spark.range(a + b).select(F.format_string("id%06d", "id").alias("sentence_id"), F.when(F.col("id") < a, "twitter").otherwise("sharechat").alias("platform"), F.lit(1).alias("rows"))


def test_stratified_sample_is_exact(spark):
    pool = _pool(spark, 601, 400).cache()
    got = sampling.stratified_sample(pool, 100).collect()
    assert len({r.sentence_id for r in got}) == 100 and sum(r.platform == "twitter" for r in got) == 61
    assert {r.sentence_id for r in got} == {r.sentence_id for r in sampling.stratified_sample(pool.repartition(7), 100).collect()}
    assert sampling.stratified_sample(pool, 1001).count() == 1001 and sampling.stratified_sample(pool, 0).count() == 0
    with pytest.raises(sampling.InsufficientData):
        sampling.stratified_sample(pool, 1002)
    assert sampling.sample_or_all(pool, 5000).count() == 1001


def test_split_of_fifty_thousand(spark):
    got = {(r.platform, r.split): r["count"] for r in sampling.stratified_split(_pool(spark, 30_000, 20_000)).groupBy("platform", "split").count().collect()}
    assert got == {("twitter", "train"): 24_000, ("twitter", "validation"): 3_000, ("twitter", "test"): 3_000, ("sharechat", "train"): 16_000, ("sharechat", "validation"): 2_000, ("sharechat", "test"): 2_000}
    assert sampling.in_several_splits(sampling.stratified_split(_pool(spark, 13, 4))).count() == 0
    with pytest.raises(ValueError):
        sampling.stratified_split(_pool(spark, 1, 1), (0.5, 0.1, 0.1))
    tiny = sampling.stratified_split(_pool(spark, 3, 2)).collect()
    assert {r.split for r in tiny} == {"train"}


def test_holdout_and_oversampling(spark):
    df = spark.range(7, 1000, 7).withColumnRenamed("id", "seq")
    held = [r.seq for r in sampling.last_tenth(df).where("held_out").collect()]
    assert sorted(held) == list(range(7, 1000, 7))[-14:]
    assert sampling.last_tenth(df.limit(3)).where("held_out").count() == 1 and sampling.last_tenth(df.limit(0)).count() == 0
    d = spark.createDataFrame([(f"{i}", i < 4) for i in range(34)], "sentence_id string, toxic boolean")
    n = sampling.oversample(d, F.col("toxic"))
    assert n.where("toxic").count() == 10 and n.where("not toxic").count() == 30 and n.where("toxic").select("sentence_id").distinct().count() == 4
    assert sampling.oversample(d, F.lit(False)).count() == 34 and sampling.oversample(d, F.col("sentence_id") < "3").count() == 34


def test_majorities(spark):
    f = lambda x: one(spark, x, "array<string>", annotation.majority_label)
    assert [f(x) for x in (["a"], ["a", "a"], [], None, ["a", "b", "a", "b"], ["b", None, None], ["a", "b", "c"])] == [None, "a", None, None, "b", None, None]
    g = lambda x: one(spark, x, "array<array<string>>", lambda c: annotation.majority_set(c, ("caste_slur", "religious", "gender", "general")))
    assert g([["caste_slur", "general"], ["caste_slur"], ["caste_slur", "religious"]]) == ["caste_slur"] and g([["general", "general"], ["x"], ["x"]]) == [] and g(None) == [] and g([None, ["general"], ["general"]]) == ["general"]
    span = "array<array<struct<start:int,end:int,entity_type:string,text:string>>>"
    h = one(spark, [[(10, 16, "LOC", ""), (0, 6, "PER", "")], [(0, 6, "PER", ""), (0, 6, "LOC", "")], [(10, 16, "LOC", "x")]], span, annotation.majority_spans)
    assert [tuple(x) for x in h] == [(0, 6, "PER"), (10, 16, "LOC")]


EXPORT = "id long, data struct<sentence_id:string,text:string,platform:string,source_url:string,collected_at:string>, annotations array<struct<result:array<struct<type:string,value:struct<choices:array<string>,labels:array<string>,start:int,end:int>>>>>"


def _choices(*c):
    return ([("choices", (list(c), None, None, None))],)


def test_exports(spark):
    at = "2024-02-01T14:00:00Z"
    data = (None, "Gehlot ne Jaipur mein", "whatsapp", None, "")
    t = spark.createDataFrame([(7, data, [_choices("positive"), _choices("positive"), _choices("neutral")]), (8, data, [_choices("positive"), _choices("negative"), ([],)]), (9, data, None)], EXPORT)
    got = {r.sentence_id: r for r in annotation.sentiment_export(t, "test", at).collect()}
    assert [got[k].sentiment for k in "789"] == ["positive", "neutral", "neutral"] and got["7"].platform == "twitter" and got["7"].split == "test" and str(got["7"].collected_at) == "1970-01-01 00:00:00"
    t = spark.createDataFrame([(1, data, [_choices("caste_slur", "general"), _choices("caste_slur", "none"), _choices("none")])], EXPORT)
    r = annotation.toxicity_export(t, annotated_at=at).first()
    assert r.toxicity_labels == ["caste_slur"] and r.toxicity_annotator_labels == [["caste_slur", "general"], ["caste_slur"], []]
    mark = lambda s, e, k="PER": ("labels", (None, [k], s, e))
    t = spark.createDataFrame([(1, data, [([mark(0, 6), mark(10, 16, "LOC"), mark(5, 5)],), ([mark(0, 6), mark(0, 6, "XXX")],), ([],)])], EXPORT)
    r = annotation.ner_export(t, annotated_at=at).first()
    assert [tuple(p) for p in r.ner_spans] == [(0, 6, "PER", "Gehlot")] and [len(x) for x in r.ner_annotator_spans] == [2, 1, 0]


def _kappa(a, b):
    n = len(a)
    po = sum(x == y for x, y in zip(a, b)) / n
    pe = sum(a.count(l) * b.count(l) for l in set(a + b)) / n / n
    return None if pe == 1 else (po - pe) / (1 - pe)


def test_kappas(spark):
    rng = random.Random(2)
    labels = {(i, a): rng.choice(("positive", "neutral", "negative")) for i in range(40) for a in (1, 2, 3)}
    rows = [("b", str(i), a, " " + v.upper()) for (i, a), v in labels.items()] * 2 + [("b", "0", 4, None)] + [("c", str(i), a, "neutral") for i in range(3) for a in (1, 2)]
    v = spark.createDataFrame(rows, "batch_id string, item_id string, annotator int, label string")
    got = {(r.batch_id, r.a, r.b): r.kappa for r in agreement.sentiment_kappa(v).collect()}
    for a, b in ((1, 2), (1, 3), (2, 3)):
        assert abs(got["b", a, b] - _kappa([labels[i, a] for i in range(40)], [labels[i, b] for i in range(40)])) < 1e-9
    assert got["c", 1, 2] is None and len(got) == 4
    batches = {r.batch_id: r for r in agreement.flagged(agreement.batch_kappa(agreement.sentiment_kappa(v), "sentiment")).collect()}
    assert batches["b"].flagged and batches["c"].degenerate and not batches["c"].flagged
    f = spark.createDataFrame([("b", t, k) for t, k in (("sentiment", 0.70), ("sentiment", 0.72), ("ner", 0.75), ("ner", 0.78), ("toxicity", 0.60), ("toxicity", 0.65))], "batch_id string, task string, kappa double")
    assert [r.flagged for r in agreement.flagged(f).collect()] == [True, False] * 3
    with pytest.raises(ValueError):
        agreement.batch_kappa(agreement.sentiment_kappa(v), "x")
    for bad in ([["a"]], [["a"], ["a", "b"]]):
        with pytest.raises(ValueError):
            agreement.check_annotators(bad)


def test_span_and_category_kappas(spark):
    spans = spark.createDataFrame([("b", "1", 1, 0, 3, "PER"), ("b", "1", 2, 0, 3, "PER"), ("b", "2", 2, 0, 3, "PER"), ("b", "2", 1, 4, 6, "LOC")], "batch_id string, item_id string, annotator int, start int, end int, entity_type string")
    judged = spark.createDataFrame([(b, i, a) for b in "bc" for i in "12" for a in (1, 2)], "batch_id string, item_id string, annotator int")
    flat = {(r.batch_id): (r.units, r.kappa) for r in agreement.span_kappa(spans, judged).collect()}
    assert flat == {"b": (2, _kappa([1, 1], [1, 0])), "c": (0, 1.0)}
    own = agreement.span_kappa(spans, judged, flat=False).collect()
    assert [(r.units, r.kappa) for r in own] == [(3, _kappa([1, 0, 1], [1, 1, 0]))]
    tox = spark.createDataFrame([("b", "1", 1, ["general"]), ("b", "1", 2, []), ("b", "2", 1, []), ("b", "2", 2, ["none"])], "batch_id string, item_id string, annotator int, labels array<string>")
    got = {r.category: r.kappa for r in agreement.toxicity_kappa(tox).collect()}
    assert got == {"caste_slur": 1.0, "religious": 1.0, "gender": 1.0, "general": 0.0}


def test_metrics_and_weights(spark):
    d = spark.createDataFrame([("positive", "positive"), ("positive", "neutral"), ("neutral", None), (None, "positive")], "g string, p string")
    got = {r.label: (r.tp, r.fp, r.fn, round(r.f1, 4)) for r in metrics.single_label(d, "g", "p").collect()}
    assert got == {"positive": (1, 0, 1, 0.6667), "neutral": (0, 1, 1, 0.0), "negative": (0, 0, 0, 0.0)}
    assert abs(metrics.macro(metrics.single_label(d, "g", "p")).first().macro_f1 - 2 / 9) < 1e-9
    m = spark.createDataFrame([(["general"], ["general", "gender"]), (None, []), (["religious"], None)], "g array<string>, p array<string>")
    assert {r.label: (r.tp, r.fp, r.fn) for r in metrics.multi_label(m, "g", "p").collect()} == {"caste_slur": (0, 0, 0), "religious": (0, 0, 1), "gender": (0, 1, 0), "general": (1, 0, 0)}
    assert metrics.should_oversample(metrics.multi_label(m, "g", "p")).first().oversample
    s = "array<struct<start:int,end:int,entity_type:string,text:string>>"
    n = spark.createDataFrame([([(0, 3, "PER", "x")], [(0, 3, "PER", "y"), (4, 6, "LOC", "z")]), (None, [])], f"g {s}, p {s}")
    assert {r.label: (r.tp, r.fp, r.fn) for r in metrics.spans(n, "g", "p").collect()} == {"PER": (1, 0, 0), "LOC": (0, 1, 0)}
    tok = "array<struct<token:string,label:string,confidence:double>>"
    t = spark.createDataFrame([([("a", "RAJ", 1.0), ("b", None, 1.0), ("c", "HIN", 1.0)], [("a", "RAJ", 1.0), ("b", "ENG", 1.0)]), (None, []), ([], [("x", "ENG", 1.0)])], f"g {tok}, p {tok}")
    got = {r.label: (r.tp, r.fp, r.fn, r.accuracy) for r in metrics.token_labels(t, "g", "p").collect()}
    assert got["RAJ"] == (1, 0, 0, 1.0) and got["HIN"] == (0, 0, 0, 1.0)
    w = spark.createDataFrame([(x,) for x in ["positive"] * 10 + ["negative"] * 5 + ["neutral"] * 2], "sentiment string")
    assert {r.label: round(r.weight, 6) for r in metrics.sentiment_weights(w).collect()} == {"positive": round(17 / 30, 6), "negative": round(17 / 15, 6), "neutral": round(17 / 6, 6)}
    assert {r.label: r.weight for r in metrics.sentiment_weights(w.where("sentiment = 'positive'")).collect()} == {"positive": 1.0, "negative": 1.0, "neutral": 1.0}
    x = spark.createDataFrame([(c,) for c in [["caste_slur"]] * 4 + [["religious"]] * 2 + [[]] * 6], "toxicity_labels array<string>")
    assert {r.label: r.weight for r in metrics.toxicity_weights(x).collect()} == {"caste_slur": 1.5, "religious": 3.0, "gender": 1.0, "general": 1.0}


LEX = [(("Rahul",), "PER"), (("Rahul", "Gandhi"), "PER"), (("Delhi",), "LOC"), (("New", "Delhi"), "LOC"), (("Rajasthan",), "LOC"), (("Gandhi",), "PER")]


def test_taggers(spark):
    for text, want in (("Rahul Gandhi visited Rajasthan", "B-PER I-PER O B-LOC"), ("He traveled to New Delhi for the meeting", "O O O B-LOC I-LOC O O O"), ("", ""), ("Jaipur, New", "O O"), ("  Gandhi  Rahul Gandhi", "B-PER B-PER I-PER")):
        df = spark.createDataFrame([(text,)], "text string").withColumn("spans", taggers.entities("text", LEX)).withColumn("tags", taggers.bio_tags("text", "spans"))
        r = df.select("spans", "tags", taggers.bio_spans("text", "tags").alias("back"), validate.bio_valid("tags").alias("ok")).first()
        assert " ".join(r.tags) == want and r.back == r.spans and r.ok
        assert all(text[p.start : p.end] == p.text for p in r.spans)
    bio = lambda tags: spark.createDataFrame([(tags,)], "t array<string>").select(validate.bio_valid("t").alias("y")).first().y
    assert [bio(t) for t in (["I-PER"], ["B-PER", "I-LOC"], [], ["O", "O"], ["B-PER", "I-PER", "I-PER"], ["B-XXX"])] == [False, False, True, True, True, False]
    lang = one(spark, "म्हारो पाणी The ghar 12 ", "string", lambda c: taggers.languages(c, ["म्हारो"], ["the"]))
    assert [(x.label, x.confidence) for x in lang] == [("RAJ", 0.9), ("HIN", 0.8), ("ENG", 0.95), ("TRL", 0.75), ("HIN", 0.6)]
    assert one(spark, "म्हारो The", "string", lambda c: taggers.with_languages(c, taggers.languages(c, ["म्हारो"], ["the"]))) == "[RAJ] म्हारो [ENG] The"
    s = lambda t: one(spark, t, "string", lambda c: taggers.sentiment(c, ["good", "best"], ["bad"]))
    assert s("Good best day").label == "positive" and abs(s("Good best day").confidence - (0.5 + 0.4 * 2 / 3)) < 1e-9
    assert (s("bad").label, s("good bad").label, s("x").confidence, s("good bad").confidence) == ("negative", "neutral", 0.6, 0.5)
    x = one(spark, "IDIOT fool", "string", lambda c: taggers.toxicity(c, {"general": [f"w{i}" for i in range(7)] + ["idiot"], "gender": []}))
    assert x.labels == ["general"] and x.scores == {"general": 0.625, "gender": 0.0}


ANN = "sentence_id string, text string, platform string, split string, sentiment string, sentiment_annotator_labels array<string>, ner_spans array<struct<start:int,end:int,entity_type:string,text:string>>, ner_annotator_spans array<array<struct<start:int,end:int,entity_type:string,text:string>>>, toxicity_labels array<string>, toxicity_annotator_labels array<array<string>>, token_language_labels array<struct<token:string,label:string,confidence:double>>, source_url string, collected_at timestamp, annotated_at timestamp"


def annotated(**k):
    import datetime as dt

    at = dt.datetime(2024, 1, 15, 10, 30)
    base = dict(sentence_id="s1", text="Gehlot Jaipur me", platform="twitter", split="train", sentiment="neutral", sentiment_annotator_labels=["neutral"], ner_spans=[(0, 6, "PER", "Gehlot")], ner_annotator_spans=[[(0, 6, "PER", "Gehlot")], []], toxicity_labels=["general"], toxicity_annotator_labels=[["general"], []], token_language_labels=[("Gehlot", "TRL", 0.75)], source_url="u", collected_at=at, annotated_at=at)
    return tuple((base | k).values())


def test_validators(spark):
    df = spark.createDataFrame([annotated(), annotated(sentence_id="s2", ner_spans=[(0, 6, "PER", "Gehlot"), (7, 13, "LOC", "Jodhpur")], ner_annotator_spans=[[], [(-2, 16, "LOC", "me"), (0, 3, "PER", "Geh!")]]), annotated(sentence_id="s3", ner_spans=None, ner_annotator_spans=None)], ANN)
    got = [(r.sentence_id, r.span_set, r.span_no, r.text_there) for r in validate.span_errors(df).collect()]
    assert got == [("s2", "ner_spans", 1, "Jaipur"), ("s2", "ner_annotator_spans[1]", 1, "Geh")] and "s2" in validate.span_errors(df).first().message
    df = spark.createDataFrame([annotated(toxicity_labels=["general", "bad", "general", "general"]), annotated(toxicity_labels=None), annotated()], ANN)
    assert [(r.error, r.labels) for r in validate.category_errors(df).collect()] == [("invalid", ["bad"]), ("duplicate", ["general", "general"])]
    df = spark.createDataFrame([annotated(), annotated(sentence_id="s2", platform="x", sentiment=None, text=None, toxicity_labels=["y"], ner_spans=[(0, 1, "Z", "")], collected_at=None)], ANN)
    assert sorted((r.field, r.value or "") for r in validate.schema_errors(df).collect()) == [("collected_at", ""), ("ner_spans", "Z"), ("platform", "x"), ("sentiment", ""), ("text", ""), ("toxicity_labels", "y")]


def test_round_trip(spark):
    a = spark.createDataFrame([annotated(sentence_id=str(i)) for i in range(4)], ANN)
    b = spark.createDataFrame([annotated(sentence_id="0", text="other", token_language_labels=[("Gehlot", "TRL", 0.7500001)]), annotated(sentence_id="1", token_language_labels=[("Gehlot", "TRL", 0.75 + 1e-12)]), annotated(sentence_id="2", toxicity_labels=None), annotated(sentence_id="9")], ANN)
    bad = validate.round_trip(a, b)
    assert sorted((r.sentence_id, r.fields) for r in bad.collect()) == [("0", ["text", "token_language_labels"]), ("2", ["toxicity_labels"]), ("3", ["missing"])]
    assert tuple(validate.round_trip_report(a, bad).first()) == (4, 1, 3)
    with pytest.raises(validate.RoundTripError, match="0: text"):
        validate.assert_round_trip(a, b)


def test_reports(spark):
    r = reports.stub_results(spark).unionByName(spark.createDataFrame([(50, "mine", "ner", 0.5), (51, "mine", "ner", 0.6), (60, "late", "ner", 0.1)], "seq int, model_name string, task string, macro_f1 double"))
    t = reports.comparison(r, ["absent", *reports.STUBS])
    rows = t.orderBy("place").collect()
    assert [x.model_name for x in rows] == ["absent", *reports.STUBS, "mine", "late"] and rows[4].ner == 0.6 and rows[0].ner != rows[0].ner
    assert "| N/A |" in reports.comparison_text(t).replace("         N/A", " N/A") and "0.6000" in reports.comparison_text(t)
    s = spark.createDataFrame([("ner", "twitter", 0.3)], "task string, platform string, macro_f1 double")
    p = reports.platform_split(s).collect()
    assert len(p) == 6 and {(x.task, x.eval_platform): x.macro_f1 for x in p}["ner", "twitter"] == 0.3
    df = spark.createDataFrame([annotated(sentence_id=str(i), ner_spans=[] if i else [(0, 6, "PER", "Gehlot")], toxicity_labels=[]) for i in range(8)], ANN)
    one_ = reports.prompts(df.limit(1), df, "ner").first().prompt
    assert one_.count("Example") == 5 and "Entities: Gehlot (PER)" in one_ and "Entities: none" in one_ and one_.endswith("Entities:")
    assert reports.prompts(df.limit(1), df.limit(0), "toxicity").first().prompt.count("Example") == 0
    assert "| all | 8 |" in reports.dataset_card("x", reports.corpus_statistics(df))


def test_early_stopping_and_retries(spark):
    f = lambda x: tuple(one(spark, x, "array<double>", training.early_stopping))
    assert f([0.5] * 10) == (1, 0.5, 4) and f([0.1, 0.2, 0.3]) == (3, 0.3, 3) and f([]) == (0, 0.0, 0) and f([0.3, 0.1, 0.4, 0.1, 0.1, 0.1, 0.9]) == (3, 0.4, 6)
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        training.retried(fail, sleep=waits.append)
    assert len(calls) == 3 and waits == [1.0, 2.0] and training.retried(lambda: 7) == 7


def _fold(events):
    """The state machine, event by event."""
    own, queue, wrong = {}, [], []
    for i, _, who, kind, what in sorted(events, key=lambda e: (e[1], e[0])):
        if kind == "assign":
            own.setdefault(who, []).append(what)
        elif kind == "opt_out":
            queue += [x for x in dict.fromkeys(own.pop(who, [])) if x not in queue]
        elif kind == "reassign":
            if what in queue:
                queue.remove(what)
            else:
                wrong.append(i)
            own.setdefault(who, []).append(what)
    return {(w, x) for w, xs in own.items() for x in xs}, set(queue), set(wrong)


def test_welfare_equals_the_state_machine(spark):
    import datetime as dt

    for seed in range(3):
        rng = random.Random(seed)
        ev = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(40)), f"a{rng.randrange(4)}", rng.choice(("assign", "assign", "assign", "opt_out", "reassign")), f"s{rng.randrange(8)}") for i in range(80)]
        df = spark.createDataFrame([(*e, 1) for e in ev], "event_id long, ts timestamp, annotator_id string, kind string, sentence_id string, n int")
        own, queue, wrong = _fold(ev)
        assert {(r.annotator_id, r.sentence_id) for r in welfare.open_assignments(df).collect()} == own
        assert {r.sentence_id for r in welfare.replacement_queue(df).collect()} == queue
        assert {r.event_id for r in welfare.invalid_reassignments(df).collect()} == wrong


def test_daily_exposure(spark):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, d, 12), a, "expose", "s", n) for i, (d, a, n) in enumerate([(1, "x", 199), (1, "y", 100), (1, "y", 100), (2, "y", 1), (1, "z", 250)])] + [(9, dt.datetime(2024, 1, 1), "x", "assign", "s", 5)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, annotator_id string, kind string, sentence_id string, n int")
    assert sorted(tuple(r) for r in welfare.daily_exposure(df).collect()) == [("x", "2024-01-01", 199, True), ("y", "2024-01-01", 200, False), ("y", "2024-01-02", 1, True), ("z", "2024-01-01", 250, False)]
