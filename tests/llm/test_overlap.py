import random

from corpuskit.llm import overlap
from corpuskit.llm.overlap import chain, coverage, cross_split_pairs, record_coverage, rolling, seeds, selected

SCHEMA = "sentence_id string, text string, split string"


def test_winnowing_selects_the_least_of_each_window():
    r = rolling([str(i) for i in range(40)])
    v, at = selected(r)
    assert len(r) == 38 and all(r[p] == x for x, p in zip(v, at))
    places = set(at.tolist())
    assert all(min((i, i + 1), key=lambda k: r[k]) in places for i in range(37))
    assert len(rolling(["a", "b"])) == 0 and len(selected(rolling(["a"]))[0]) == 0


def test_chain_is_collinear():
    assert chain([(0, 5), (1, 1), (2, 2), (3, 0), (4, 6)]) == [(1, 1), (2, 2), (4, 6)] and chain([]) == []
    w = [f"w{i}" for i in range(20)]
    assert all(p == q for p, q in seeds(w, w))


def test_coverage():
    w = "a bb ccc dddd eeeee ffffff ggg hhh iii jjj".split()
    assert coverage(w, w[:-1]) == 0.9 and coverage(w, "x y z".split()) == 0 and coverage(w, w) == 1
    assert coverage(w, [*w[5:6], *w[:5], *w[6:]]) == 1
    assert coverage(w, [*w[:5], "fffffx", *w[6:]]) == 1
    assert coverage([], []) == 0


def _edited(w, rng, words, even):
    w, n = list(w), len(w)
    for p in sorted(range(2, 5 * (n // 5), 5) if even else rng.sample(range(n), n // 5), reverse=True):
        kind = "replace" if even else rng.choice(("replace", "drop", "add", "move", "spell"))
        if kind == "replace":
            w[p] = rng.choice(words)
        elif kind == "drop":
            del w[p]
        elif kind == "add":
            w.insert(p, rng.choice(words))
        elif kind == "spell":
            w[p] = w[p][:1] + w[p][2:] + w[p][1:2] if len(w[p]) > 4 else w[p] + "x"
        else:
            x = w.pop(p)
            w.insert(rng.randrange(len(w) + 1), x)
    return w


def test_recall_with_one_word_in_five_edited(spark):
    """Every fifth word (even) or random places; all edits that are allowed are used. No pair of unlike texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    rows, want = [], {}
    for lo, hi in ((5, 7), (8, 9), (10, 14), (15, 19), (20, 30), (31, 60)):
        for even in (False, True):
            for _ in range(200):
                x = [rng.choice(words) for _ in range(rng.randint(lo, hi))]
                y = _edited(x, rng, words, even)
                if rng.random() < 0.5:
                    x, y = y, x
                i = len(want)
                rows += [(f"{i}a", " ".join(x), "train"), (f"{i}b", " ".join(y), "test")]
                want[f"{i}a", f"{i}b"] = (lo, even)
    got = {(r.id_train, r.id_eval) for r in cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got <= set(want)
    recall = {k: sum(p in got for p, v in want.items() if v == k) / 200 for k in set(want.values())}
    print(sorted(recall.items()))
    for (lo, even), share in recall.items():
        assert share >= (0.98 if lo < 10 else 0.95), (lo, even, share)


def test_splitting_hot_fingerprints_changes_nothing(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "kmtr" for b in "aeiou" for c in ("lo", "sta", "ndi", "pur")]
    opening = "suno suno sab log aaj".split()
    rows = []
    for i in range(300):
        x = opening + [rng.choice(words) for _ in range(rng.randint(6, 14))] if i % 3 else [rng.choice(words) for _ in range(rng.randint(4, 16))]
        rows += [(f"{i}a", " ".join(x), "train"), (f"{i}b", " ".join(_edited(x, rng, words, False)), "test")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = []
    for hot in (10**9, 20, 0):
        monkeypatch.setattr(overlap, "HOT", hot)
        got.append({tuple(r) for r in cross_split_pairs(df).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) >= 290


def test_copies_cases_and_names(spark):
    long = "ek do teen char paanch chhe saat aath nau das gyarah barah"
    rows = [("1", long, "train"), ("2", "FWD: " + long.upper() + " #tag", "test"), ("2", long, "test"), ("3", long, "train"), ("4", None, "test"), ("5", "", "test"), ("6", "...", "train"), ("7", "x y", "train"), ("7", "x y", "validation"), ("8", "X  y!", "test"), ("9", long, None)]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], SCHEMA + ", wording string, w int")
    assert sorted(tuple(r) for r in cross_split_pairs(df).collect()) == [("1", "2", 1.0), ("3", "2", 1.0), ("7", "8", 1.0)]
    got = {(r.sentence_id, r.side): (r.partners, r.coverage) for r in record_coverage(df).collect()}
    assert got["1", 1] == got["3", 1] == got["2", 2] == (1, 1.0) and ("9", 2) not in got
    assert cross_split_pairs(df.limit(0)).count() == 0


def test_one_opening_is_not_enough(spark):
    rng = random.Random(5)
    opening = "suno suno sab log aaj ki badi khabar"
    rows = [(str(i), opening + " " + " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)), "train" if i % 2 else "test") for i in range(400)]
    assert cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).count() == 0


