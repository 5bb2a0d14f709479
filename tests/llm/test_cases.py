import random

from corpuskit.llm.bpe import count_tokens, encode, encoder, vocabulary
from corpuskit.llm.pieces import RangeMax, pieces, split
from corpuskit.llm.unify import odd_records, unify

TEXTS = [None, "", " ", "hello <|endoftext|> world", "क" * 40_000, "a" * 200_000, "😀👩‍🌾 x\r\n\r\n y", "12½ m² 3¾", "​"]


def test_encoding_of_every_kind_of_text(spark):
    df = spark.createDataFrame([(i, t, [1], 7) for i, t in enumerate(TEXTS)] + [(0, None, None, None), (None, "x", None, None)], "doc_id long, text string, ids array<int>, n_tokens long")
    e = encoder(vocabulary())
    back = {v: k for k, v in e.ranks.items()}
    got = encode(df).collect()
    assert len(got) == len(TEXTS) + 2 and sum(r.doc_id == 0 for r in got) == 2
    for r in got:
        t = "x" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert b"".join(back[i] for i in r.ids).decode() == t
    n = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert all(n[r.doc_id] == len(r.ids) for r in got) and n[0] == n[1] == 0
    assert encode(df.limit(0)).count() == 0


def test_special_tokens_are_ordinary_text():
    e = encoder(vocabulary())
    assert e.count("<|endoftext|>") > 1


def test_range_maximum_is_the_rightmost_strongest():
    import numpy as np

    rng = random.Random(1)
    v = np.array([rng.randrange(5) for _ in range(300)])
    index = RangeMax(v, 65)
    for _ in range(500):
        lo = rng.randrange(300)
        hi = min(299, lo + rng.randrange(65))
        best = max(range(lo, hi + 1), key=lambda i: (v[i], i))
        assert index.best(lo, hi) == best


def test_cuts_stand_at_the_strongest_boundaries():
    e = encoder(vocabulary())
    para = "One two three four five six seven eight nine ten. " * 6
    text = "\n\n".join([para] * 8)
    got = pieces(text, e, 120, 12)
    assert all(e.count(text[a:b]) == n <= 120 for a, b, n in got) and "".join(text[(got[i - 1][1] if i else 0) : b] for i, (_, b, _) in enumerate(got)) == text
    inner = [text[:b].rstrip(" ")[-1:] for _, b, _ in got[:-1]]
    assert all(c in ".\n" for c in inner)
    over = [e.count(text[b[0] : a[1]]) for a, b in zip(got, got[1:])]
    assert all(10 <= n <= 16 for n in over)


def test_splitting_of_every_kind_of_text(spark):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], 5, "x")], "doc_id long, text string, pieces int, piece_no string")
    got = split(df, 100, 10, "byte_bpe_50k").collect()
    assert {r.doc_id for r in got} == {4, 5} and all(r.n_tokens <= 100 and r.text == TEXTS[r.doc_id][r.start_at : r.end_at] for r in got)
    for i in (4, 5):
        own = sorted({(r.piece_no, r.start_at, r.end_at, r.pieces) for r in got if r.doc_id == i})
        assert own[0][1] == 0 and own[-1][2] == len(TEXTS[i]) and [o[0] for o in own] == list(range(own[0][3])) and all(b[1] < a[2] for a, b in zip(own, own[1:]))
    assert sum(r.doc_id == 4 for r in got) == 2 * len({r.piece_no for r in got if r.doc_id == 4})
    whole = {r.doc_id for r in split(df, 100, 10, "byte_bpe_50k", only_cut=False).collect()}
    assert whole == {2, 3, 4, 5, 6, 7, 8}
    assert split(df.limit(0), 100, 10, "byte_bpe_50k").count() == 0


def test_forms_of_every_kind_of_text(spark):
    df = spark.createDataFrame([(str(i), t, "old", 1) for i, t in enumerate(TEXTS)] + [(None, "a​b", None, None)], "sentence_id string, text string, plain_text string, i int")
    got = {r.sentence_id: r for r in unify(df).collect()}
    assert got["0"].plain_text is None and got["1"].plain_text == "" and got["8"].plain_text == "" and got[None].plain_text == "ab" and got["5"].plain_text == TEXTS[5] and got["5"].i == 1
    assert {r.key for r in odd_records(df, "sentence_id").collect()} == {"8", None}
