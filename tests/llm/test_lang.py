import numpy as np

from corpuskit.llm.canon import spelt, spoken
from corpuskit.llm.lang import LANGS, Evidence, _BLANK, host_counts, model, text_language, token_units, units, word_counts

NONE = (np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros(0, np.int64), np.zeros((0, 4)), np.full((4, 4), 0.01) + 0.96 * np.eye(4))
ANN = "sentence_id string, text string, token_language_labels array<struct<token string, label string, confidence double>>, source_url string, lang string"
DOC = "doc_id long, text string, lang string, source string, source_url string, kind string"


def test_spelling():
    assert spelt("Wee,") == "wee" and spoken("Wee,") == "we" and spelt("\ufe0f") == spelt("12") == spelt("#a") == ""


def test_tokens_are_hidden_by_place():
    texts = ["घर का पता वार्ड 8, घर 159, गली 3, Lunpura घर से बाहर", "\u200bmail a.b (at) c (dot) test and (c) test", "no span ❤\ufe0f", "पता 35 केसर विहार, पुरानी बावड़ी के पास, खेजड़सर जवाब", "mail kheti+x AT thal DOT dak DOT example now"]
    e = Evidence(NONE)
    got = [[(t.split()[k], k) for k, *_ in token_units(t, e, None)] for t in texts]
    assert [w for w, _ in got[0]][:3] == ["घर", "का", "पता"] and ("वार्ड", 3) not in got[0] and ("घर", 5) not in got[0]
    assert [k for _, k in got[1]] == [0, 6, 7, 8] and [k for _, k in got[2]] == [0, 1]
    assert [w for w, _ in got[3]] == ["पता", "जवाब"] and [w for w, _ in got[4]] == ["mail", "now"]


def test_spellings_of_a_word_count_together(spark):
    tokens = [("Wee,", "ENG"), ("we.", "ENG"), ("खेत", "RAJ"), ("खेत।", "HIN"), ("#tag", "ENG"), (None, "ENG"), ("x", None)]
    df = spark.createDataFrame([(tokens,)], "token_language_labels array<struct<token string, label string>>")
    got = {r.key: (r.n0, r.n1, r.n2, r.n3) for r in word_counts(df).collect()}
    assert got == {"=wee": (0, 0, 1, 0), "=we": (0, 0, 1, 0), "~we": (0, 0, 2, 0), "=खेत": (1, 1, 0, 0), "~खेत": (1, 1, 0, 0)}


def _tables(spark, d):
    words = {"RAJ": "म्हारो थारो कोनी घणो", "HIN": "मेरा तेरा नहीं बहुत", "ENG": "house water river good", "TRL": "mera tera nahin bahut"}
    rows = []
    for i in range(60):
        toks = [(w, l, 0.9) for l, ws in words.items() for w in ws.split()]
        toks = [(w, "HIN" if (i + k) % 20 == 0 else l, c) for k, (w, l, c) in enumerate(toks)]
        rows.append((f"s{i}", " ".join(w for w, *_ in toks), toks, "https://x.example/1", "clash"))
    rows += [("n", None, None, None, "c"), ("e", "", [], "", "c"), ("m", "mera house", None, "bad url", "c")]
    spark.createDataFrame(rows, ANN).write.parquet(f"{d}/annotated_sentences.parquet")
    hin, raj = " ".join([words["HIN"]] * 4), " ".join([words["RAJ"]] * 4)
    docs = [(i, hin, "HIN", "blog/h", "https://h.example/a", "k") for i in range(30)] + [(40, f"{hin}\n \n{raj}\r\n\r\n12 !!", "HIN", "blog/h", None, "k"), (41, "house water", "und", "blog/q", "ftp://Q.example", "k"), (42, "मेरा म्हारो", "RAJ", "blog/z", "https://z.test/", "k"), (43, None, None, None, None, "k"), (44, " \n\n ", "HIN", "", "", "k")]
    spark.createDataFrame(docs, DOC).write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_labels_gone_wrong_are_found(spark, tmp_path):
    d = _tables(spark, tmp_path)
    got = {(r.record_id, r.kind, r.unit_no): r for r in units(spark, d).collect()}
    wrong = [r for r in got.values() if r.kind == "token" and r.stated and r.stated != r.lang]
    assert wrong and all(r.stated == "HIN" and r.lang != "HIN" and r.confidence > 0.99 for r in wrong)
    assert {r.lang for k, r in got.items() if k[0] == "m"} == {"TRL", "ENG"} and all(r.stated is None for k, r in got.items() if k[0] == "m")
    assert [got["40", "block", k].lang for k in (0, 1)] == ["HIN", "RAJ"] and ("40", "block", 2) not in got
    assert got["40", "document", None].lang == "HIN" and got["41", "block", 0].lang == "ENG" and got["42", "block", 0].lang == "RAJ"
    assert not {"43", "44", "n", "e"} & {k[0] for k in got}
    assert all(0.25 <= r.confidence <= 1 for r in got.values())


def test_one_word_more_outweighs_the_other_evidence():
    e = Evidence(NONE)
    e.host_priors["h"] = np.log([0.97, 0.01, 0.01, 0.01]).tolist()
    assert LANGS[text_language([(0, 1, -20.0)] * 5 + [(0, 1, 20.0)] * 4, e, "RAJ", "h")[0]] == "HIN"
    assert LANGS[text_language([(0, 1, -20.0)] * 4 + [(0, 1, 20.0)] * 4, e, "RAJ", "h")[0]] == "RAJ"
    assert LANGS[text_language([(0, 1, -0.2)] * 3, e, "RAJ", "h")[0]] == "RAJ"


def test_priors_are_smoothed_upwards(spark, tmp_path):
    d = _tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = {r.key: (r.n0, r.n1) for r in host_counts(docs).collect()}
    assert n["h:h.example"] == (0, 30) and n["h:h"] == (0, 1) and n["s:example"] == (0, 30) and n["c:"] == (1, 32)
    e = Evidence(model(spark.read.parquet(f"{d}/annotated_sentences.parquet"), docs))
    p = {h: np.exp(e.prior(h)) for h in ("h.example", "z.test", "new.example", None)}
    assert all(abs(x.sum() - 1) < 1e-9 for x in p.values())
    assert p["h.example"][1] > p["new.example"][1] > p[None][1] > p["z.test"][1] > 0.25


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], ANN).write.parquet(f"{tmp_path}/annotated_sentences.parquet")
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert units(spark, str(tmp_path)).count() == 0


def test_blocks_end_at_blank_lines():
    assert _BLANK.split("a\nb\n\t\nc\r\n \r\nd") == ["a\nb", "c", "d"]
