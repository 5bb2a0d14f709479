import datetime
import random

import numpy as np

from corpuskit.llm.privacy import DATE, Names, check_sum, date_pseudonym, finds, hidden, name_table, number_pseudonym, permute, permute_digits, private_finds, pseudonym, redact


def test_private_finds():
    t = "call +91 57559 94302, mail a.b (at) c (dot) test; parcel 9178918279 Plot 5, Sector 2, Lunpura-012345 or x AT y DOT z"
    assert [k for k, *_ in finds(t, Names())] == ["phone", "email", "address", "email"]
    a = {permute_digits(f"{i:03d}", b"k") for i in range(1000)}
    assert len(a) == 1000
    assert finds("", Names()) == [] and finds("look at the dot", Names()) == []


def test_addresses_are_whole():
    for t in ("35 केसर विहार, पुरानी बावड़ी के पास, खेजड़सर", "वार्ड 19, घर 64, कोट मोहल्ला, थळनगर", "54, Old Stepwell Road, Sursagarh", "H.No. 142/D, Kesar Vihar, Titarsar 067560", "ward no 20 house 134, kot mohalla, ranakvas"):
        assert finds("pata: " + t + " aur", Names()) == [("address", 6, 6 + len(t))]


def test_pseudonyms_of_one_phone_number_agree():
    forms = ("57559 94302", "+91 57559 94302", "0091-57559-94302", "05755-994302", "(0575) 599 4302", "५७५५९ ९४३०२", "5755994302")
    got = ["".join(str(int(c)) for c in pseudonym("phone", v, b"k") if c.isdigit()) for v in forms]
    assert len({g[-10:] for g in got}) == 1 and got[0] != "5755994302" and [g[:-10] for g in got] == ["", "91", "0091", "0", "0", "", ""]
    assert number_pseudonym("phone", "५७५५९ ९४३०२", b"k")[0] in "१२३४५६७८९"


def test_permutations_are_bijections_that_can_be_undone():
    for n in (2, 7, 100, 3001):
        assert sorted(permute(x, n, b"k") for x in range(n)) == list(range(n))
        assert all(permute(permute(x, n, b"k"), n, b"k", back=True) == x for x in range(0, n, 7))
    assert permute(5, 10**12, b"k") != permute(5, 10**12, b"other")


def test_numbers_keep_their_format():
    for v in ("ABCDE1234F", "abcde1234f", "ABC/1234567", "RX14 20110012345", "1546 5835 2777", "0826-5232-8193"):
        p = number_pseudonym("id_number", v, b"k")
        assert len(p) == len(v) and all(a.isdigit() == b.isdigit() and a.isalpha() == b.isalpha() and a.islower() == b.islower() for a, b in zip(v, p)) and p != v
    assert number_pseudonym("id_number", "ABCDE1234F", b"k") == number_pseudonym("id_number", "abcde1234f", b"k").upper()
    assert number_pseudonym("id_number", "ABC/1234567", b"k").replace("/", "") == number_pseudonym("id_number", "ABC1234567", b"k")
    assert number_pseudonym("id_number", "RX14-20110012345", b"k").startswith("RX")
    assert check_sum("2363") == 0 and check_sum("2364") != 0
    rng = random.Random(1)
    for _ in range(50):
        n = "".join(rng.choice("0123456789") for _ in range(11))
        n += next(d for d in "0123456789" if check_sum(n + d) == 0)
        assert check_sum(number_pseudonym("id_number", n, b"k")) == 0


def test_dates_on_request():
    t = "born 15/08/1994 or 2024-02-29, not 31/02/2024"
    assert [k for k, *_ in finds(t, Names())] == [] and [t[a:b] for _, a, b in finds(t, Names(), dates=True)] == ["15/08/1994", "2024-02-29", "31/02/2024"]
    p = date_pseudonym("15/08/1994", b"k")
    assert DATE.fullmatch(p) and datetime.date(int(p[6:]), int(p[3:5]), int(p[:2])) and p != "15/08/1994"
    q = date_pseudonym("1994-08-15", b"k")
    assert (q[:4], q[5:7], q[8:]) == (p[6:], p[3:5], p[:2]) and date_pseudonym("31/02/2024", b"k") is None
    assert hidden("on 31/02/2024", Names(), b"k", dates=True) == "on <date:31/02/2024>"


def test_spellings_of_a_mail_address_are_linked():
    got = {pseudonym("email", v, b"k") for v in ("a.b@c.test", "A.B (at) c (dot) test", "a.b [at] c [dot] test", "a.b AT c DOT test", "a.b @ c.test")}
    assert len(got) == 1 and len(pseudonym("email", "a@b.c", b"k")) == len("<email:>") + 20


ROWS = [("Ravi Medhkar aaya", ["Ravi Medhkar"])] * 4 + [("Ravi bola", ["Ravi"]), ("medhkar sa", None), (None, None), ("", []), ("dr. Zulfi aaya", []), ("zamana accha", [None])]


def _annotated(spark):
    rows = [(str(i), t, [(0, len(p or ""), "PER", p) for p in ps] + [(0, 4, "LOC", "zamana")] if ps is not None else None, "x") for i, (t, ps) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "sentence_id string, text string, ner_spans array<struct<start int, end int, entity_type string, text string>>, record_id string")


def test_names_by_spans_and_titles(spark):
    a = _annotated(spark)
    names = Names(name_table(a))
    assert (names["ravi"], names["medhkar"], names["zulfi"], names["zamana"], names["aaya"], names["dr"]) == (1, 2, 3, 0, 0, 0)
    f = lambda t: [t[x:y] for k, x, y in finds(t, names) if k == "name"]
    assert f("Shri Ravi Medhkar, R. Medhkar aur Dr. Zulfi") == ["Ravi Medhkar", "R. Medhkar", "Zulfi"]
    assert f("zulfi #ravi @ravi medhkar") == [] and f("Rа\u200bvi Medhkar") == ["Rа\u200bvi Medhkar"]
    assert name_table(a.limit(0))[0].shape == (0,)


def test_texts_and_finds(spark):
    a = _annotated(spark)
    rec = spark.createDataFrame([("1", "Ravi: 57559 94302."), ("2", "+91 57559 94302"), ("3", None), ("4", ""), ("1", "Ravi: 57559 94302.")], "record_id string, text string")
    got = {r.record_id: r.text for r in redact(rec, a, b"k").collect()}
    own = number_pseudonym("phone", "57559 94302", b"k")
    assert got == {"1": f"{pseudonym('name', 'ravi', b'k')}: <phone:{own}>.", "2": f"<phone:+91 {own}>", "3": None, "4": ""}
    f = private_finds(rec, a, b"k").distinct().collect()
    assert sorted((r.record_id, r.kind, r.start_at, r.end_at) for r in f) == [("1", "name", 0, 4), ("1", "phone", 6, 17), ("2", "phone", 0, 15)]
    assert private_finds(rec.limit(0), a.limit(0), b"k").count() == 0
