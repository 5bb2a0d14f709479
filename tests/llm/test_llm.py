from corpuskit.llm.bpe import encoder, merge_long, merge_short, vocabulary
from corpuskit.llm.canon import plain, skeleton, spoken
from corpuskit.llm.pieces import pieces
from corpuskit.llm.unify import odd_records, unify


def test_plain_and_skeleton():
    assert plain("Тіtar") == "Titar" and plain("a​b") == "ab" and plain(None) == ""
    assert plain("❤️") == "❤️" and plain("Ａ½") == "A½"
    assert skeleton("FWD: Hello, #tag http://x.test WORLD") == ["hello", "world"]
    assert spoken("n4ng1") == "nangi" and spoken("#x") == ""


def test_both_forms_agree_on_odd_texts(spark):
    texts = ["Москва", "нос", "еѕ to", "ѕе kaam", "сор и рост мышь", "pаlасе", "Ελλάδα", "ﬁne oﬃce", "a\ufdd0b", "x½ y² \u2763\ufe0f", "Ｆｕｌｌ", "a\u00a0b", "\U0001f469\u200d\U0001f33e", "е\u0301x", "" , None, "बा\u200dत", "Κα", "αβ", "І.", "Мoсkвa"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "sentence_id string, text string")
    got = {r.text: r.plain_text for r in unify(df).collect()}
    for t in texts:
        assert got[t] == (plain(t) if t else t), (t, got[t], plain(t))
    assert got["Москва"] == "Москва" and got["нос"] == "нос" and got["ѕе kaam"] == "se kaam" and got["сор и рост мышь"] == "сор и рост мышь" and got["ﬁne oﬃce"] == "fine office" and got["pаlасе"] == "palace" and got["a\ufdd0b"] == "ab"
    assert odd_records(df, "sentence_id").where("key in (0, 1, 4, 6)").count() == 0


def test_unify_matches_plain(spark):
    rows = [("1", None), ("2", ""), ("3", "a​b"), ("4", "plain"), ("3", "a​b"), ("5", "अा")]
    df = spark.createDataFrame(rows, "sentence_id string, text string")
    assert [r.plain_text for r in unify(df).orderBy("sentence_id").collect()] == [None, "", "ab", "ab", "plain", "आ"]
    assert sorted(r.key for r in odd_records(df, "sentence_id").collect()) == ["3", "5"]
    assert unify(df.limit(0)).count() == 0


def test_bpe_short_equals_long_and_round_trip():
    e = encoder(vocabulary())
    back = {v: k for k, v in e.ranks.items()}
    for w in ("hello", "मरुधरा", "a" * 500, "<|endoftext|>", "😀 x\n\n y"):
        assert merge_short(w.encode(), e.ranks) == merge_long(w.encode(), e.ranks)
        assert b"".join(back[i] for i in e.ids(w)).decode() == w
    assert len(e.ids(None)) == len(e.ids("")) == 0


def test_pieces_cover_the_text():
    e = encoder(vocabulary())
    for text in ("word one. " * 400, "क" * 900, "line\n\n" * 300):
        got = pieces(text, e, 100, 10)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(n <= 100 for *_, n in got) and all(b[0] <= a[1] for a, b in zip(got, got[1:]))
    assert pieces("", e, 100, 10) == []
