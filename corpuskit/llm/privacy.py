"""Problem 6: find personal information in free text and replace it.

Emails, phone and identity numbers and addresses are found by format. Names are found by their words: those that stand in
gold person spans of annotated_sentences often enough, and those that follow a title often enough, by counts over all its
texts. Method of replacement: format-preserving Feistel pseudonyms. A number's letters and digits are one integer of a
mixed radix, permuted under a key by a Feistel network inside the set of numbers of its format, and written back into its
own layout: separators, brackets, case, script of the digits, and country, trunk and state codes stay. Twelve-digit
identity numbers whose check digit is right (Verhoeff) are permuted among those whose check digit is right. All
spellings of a value are one integer, so equal values stay linked across documents, and the permutation can be undone
with the key. Dates are permuted the same way, but only with ``dates``: they are no personal information here. Other
kinds get a keyed tag of 80 bits of their folded value. The placeholder is ``<kind:pseudonym>``.

Name counts are a table of fixed size (``BUCKETS`` at two hashed places, 3 numbers each), exact while a word is alone at
one of its places; no word is left out, however large the corpus.

Cases: null text gives null and no finding; empty text stays empty; overlapping finds keep the first kind of email,
address, id_number, phone, name; places count in the unchanged text; an empty table gives an empty result; other columns
are ignored; without person spans only titles show names.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.canon import plain_map

BUCKETS = 1 << 20
#: A word is a name if it is one in so many person spans (after so many titles), and in this share of its places.
LEAST, SHARE = 3, 0.3
#: The key where the session has none in ``spark.corpuskit.key``; for tests, as it is no secret.
DEFAULT_KEY = "corpuskit"
_D = r"[0-9०-९]"
EMAIL = regex.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*(?:(?: ?@ ?| ?[(\[]at[)\]] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)+| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)", regex.I)
_HOUSE = r"(?:ward(?: no\.?)?|वार्ड(?: नं\.?)?|plot(?: no\.?)?|प्लॉट|flat(?: no\.?)?|फ्लैट|h\.? ?no\.?|house no\.?|मकान नं\.?|घर नं\.?)"
_LOCAL = r"(?:sector|सेक्टर|गली|gali|lane|मोहल्ला|mohalla|vihar|विहार|heights|colony|कॉलोनी|nagar|नगर|road|marg|मार्ग|घर|house)"
#: A part of an address: it names a locality, a house or what it is near.
_PART = rf"[^,\n।!?;()]{{0,40}}?(?<![\p{{L}}\p{{M}}])(?:{_LOCAL}|के पास|ke paas|near [\p{{L}}\p{{M}}]+)(?![\p{{L}}\p{{M}}])[^,\n।!?;.()]{{0,20}}?"
_BEGIN = rf"(?:{_HOUSE} ?{_D}{{1,5}}(?:/[A-Za-z])?,? (?=[^\n]{{0,40}}?{_LOCAL})|{_D}{{1,4}},? (?=(?:[\p{{L}}\p{{M}}]+ ){{1,2}}{_LOCAL}\b))"
_PIN = r"(?: ?-? ?\d{6})?"
#: Parts up to a town of one word; what does not fit ends at the second comma or sign.
ADDRESS = regex.compile(rf"(?<![\w\p{{M}}#]){_BEGIN}(?:{_PART}(?:, ?{_PART})*, ?[\p{{L}}\p{{M}}]+(?![\p{{L}}\p{{M}}]){_PIN}|[^,\n।!?;]{{1,40}}(?:, ?[^,\n।!?;.]{{2,40}}?(?=[,\n।!?;.)]|$| ?-? ?\d{{6}}|\s\S)){{1,2}}{_PIN})", regex.I)
IDS = regex.compile(rf"(?<![\w-])(?:[A-Za-z]{{5}}{_D}{{4}}[A-Za-z]|[A-Za-z]{{3}}/?{_D}{{7}}|RX{_D}{{2}}[ -]?{_D}{{11}}|(?P<twelve>{_D}{{4}}(?P<s>[ -]?){_D}{{4}}(?P=s){_D}{{4}}))(?![\w])", regex.I)
PHONE = regex.compile(rf"(?<![\w₹.,/#+-])(?:(?:\+|[0०]{{2}})[9९][1१][ -]?{_D}{{5}}[ -]?{_D}{{5}}|\({_D}{{4}}\) {_D}{{3}} {_D}{{4}}|[0०]{_D}{{4}}-{_D}{{6}}|{_D}{{5}}[ -]{_D}{{5}}|{_D}{{3}}\.{_D}{{3}}\.{_D}{{4}}|{_D}{{10}})(?!{_D}|\w|[-/]\d)")
#: Words before numbers that are no personal data.
TRADE = regex.compile(r"(?:पार्सल|parcel|order|ऑर्डर|बिल|bill|invoice|trk)[\s:#(]*(?:no\.?|नं\.?)?[\s:#(]*$", regex.I)
MAILED = regex.compile(r"@|at[)\]]| at .* dot ", regex.I)
TITLES = {"श्री", "श्रीमती", "डॉ", "shri", "smt", "dr", "mr", "mrs", "ms"}
_WORDS = regex.compile(r"[\p{L}\p{M}]+")
_DIGIT = regex.compile(_D)


#: No names although they stand in person spans: forms of address.
ADDRESSED = {"जी", "ji", "सा", "sa"}
DATE = regex.compile(rf"(?<![\w/.-])(?:(?P<d>{_D}{{1,2}})(?P<s>[/.-])(?P<m>{_D}{{1,2}})(?P=s)(?P<y>(?:19|20|१९|२०){_D}{{2}})|(?P<y2>(?:19|20){_D}{{2}})-(?P<m2>{_D}{{2}})-(?P<d2>{_D}{{2}}))(?![\w/-])")


class Names(dict):
    """Words in lower case to 1 (given name), 2 (surname), 3 (after titles only) or 0, from the table of counts."""

    def __init__(self, table: tuple = (np.zeros(0, np.int64), np.zeros((0, 4)))):
        super().__init__()
        self.places, self.counts = table

    def __missing__(self, w: str) -> int:
        best = None
        for p in _places(w):
            i = int(np.searchsorted(self.places, p))
            c = self.counts[i] if i < len(self.places) and self.places[i] == p else np.zeros(4)
            best = c if best is None or c[3] < best[3] else best
        first, later, titled, n = best
        kind = 0
        if len(w) > 1 and w not in TITLES and w not in ADDRESSED:
            if first + later >= LEAST and first + later >= SHARE * n:
                kind = 1 if first >= later else 2
            elif titled and titled >= SHARE * n:
                kind = 1 if titled >= LEAST else 3
        if len(self) > 500_000:
            self.clear()
        self[w] = kind
        return kind


def _places(w: str) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh64_intdigest(w)
    return h % BUCKETS, BUCKETS + (h >> 32) % BUCKETS


def finds(text: str, names: Names, dates: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the given text, in order."""
    t, at = plain_map(text)
    out: list[tuple[int, int, str]] = []

    def add(kind: str, a: int, b: int) -> None:
        i = bisect_right(out, (a, b, kind))
        if (not i or out[i - 1][1] <= a) and (i == len(out) or out[i][0] >= b):
            out.insert(i, (a, b, kind))

    if MAILED.search(t):
        for m in EMAIL.finditer(t):
            add("email", *m.span())
    if _DIGIT.search(t):
        links = [m.span() for m in regex.finditer(r"https?://\S+", t)]
        for m in ADDRESS.finditer(t):
            add("address", *m.span())
        for kind, p in (("id_number", IDS), ("phone", PHONE)):
            for m in p.finditer(t):
                a = m.start()
                if any(x <= a < y for x, y in links) or TRADE.search(t[max(0, a - 24) : a]):
                    continue
                add(kind, a, m.end())
        for m in DATE.finditer(t) if dates else ():
            add("date", *m.span())
    low = [w.lower() for w in _WORDS.findall(t)]
    kinds = [names[w] for w in low]
    words = [(w, *m.span()) for w, m in zip(low, _WORDS.finditer(t))] if any(kinds) else []
    i = 0
    while i < len(words):
        kind = kinds[i]
        if not kind:
            i += 1
            continue
        w, a, b = words[i]
        j = i + 1
        start = None
        free = a == 0 or t[a - 1] not in "#@_/"
        if kind == 1 and free:
            start = a
        elif kind and i and free:
            p, pa_, pb = words[i - 1]
            if kind == 2 and t[pb:a] in (". ", ".") and (len(p) == 1 or len(p) <= 3 and "ऀ" <= p[0] <= "ॿ") and p not in TITLES:
                start = pa_
            elif p in TITLES and t[pb:a].strip(" .") == "":
                start = a
        if start is not None:
            while j < len(words) and kinds[j] == 2 and t[words[j - 1][2] : words[j][1]] == " ":
                j += 1
            add("name", start, words[j - 1][2])
        i = j
    if at is not None:
        return [(k, at[a], at[b - 1] + 1) for a, b, k in out]
    return [(k, a, b) for a, b, k in out]


def permute(x: int, n: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..n-1: ten rounds of an alternating Feistel network over two factors whose product is just
    above n, walked on until the value is below n."""
    if n < 2:
        return x
    a = int(n**0.5) + 1
    b = -(-n // a)
    rounds = range(10)
    while True:
        u, v = divmod(x, b)
        for i in reversed(rounds) if back else rounds:
            h = int.from_bytes(hmac.new(key, f"{n}|{i}|{v if i % 2 == 0 else u}".encode(), hashlib.sha256).digest()[:12], "big")
            h = -h if back else h
            if i % 2 == 0:
                u = (u + h) % a
            else:
                v = (v + h) % b
        x = u * b + v
        if x < n:
            return x


def permute_digits(digits: str, key: bytes) -> str:
    """A keyed permutation of the digit strings of one length."""
    return str(permute(int(digits), 10 ** len(digits), key)).zfill(len(digits)) if digits else digits


# Multiplication and permutation tables of the Verhoeff check digit are those of the dihedral group D5.
def _times(a: int, b: int) -> int:
    return (a + b) % 5 + 5 * (b >= 5) if a < 5 else (a - b) % 5 + 5 * (b < 5)


_TURN = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def check_sum(digits: str) -> int:
    """0 if the last digit is the right Verhoeff check digit."""
    c = 0
    for i, ch in enumerate(reversed(digits)):
        x = int(ch)
        for _ in range(i % 8):
            x = _TURN[x]
        c = _times(c, x)
    return c


def _refill(value: str, letters_digits: str) -> str:
    """The new letters and digits in the layout of the old value: separators, case and script of the digits stay."""
    new, out = iter(letters_digits), []
    for c in value:
        if c.isdigit():
            d = next(new)
            out.append(chr(ord(c) - int(c) + int(d)))
        elif c.isalpha():
            d = next(new)
            out.append(d.lower() if c.islower() else d)
        else:
            out.append(c)
    return "".join(out)


def _permuted_form(form: str, key: bytes) -> str:
    """Letters A-Z and digits permuted as one integer of a mixed radix."""
    x, n = 0, 1
    for c in form:
        r = 10 if c.isdigit() else 26
        x, n = x * r + (int(c) if c.isdigit() else ord(c) - 65), n * r
    x, out = permute(x, n, key), []
    for c in reversed(form):
        x, d = divmod(x, 10 if c.isdigit() else 26)
        out.append(str(d) if c.isdigit() else chr(65 + d))
    return "".join(reversed(out))


def number_pseudonym(kind: str, value: str, key: bytes) -> str:
    """A phone or identity number of the same format; the same for all spellings of one number."""
    form = "".join(str(int(c)) if c.isdigit() else c.upper() for c in value if c.isdigit() or c.isascii() and c.isalpha())
    if kind == "phone":
        k = max(0, len(form) - 10)
        code, own = form[:k], form[k:]
        if len(own) == 10 and own[0] != "0":
            own = str(permute(int(own) - 10**9, 9 * 10**9, key) + 10**9)
        else:
            own = permute_digits(own, key)
        return _refill(value, code + own)
    if form.isdigit() and len(form) == 12 and check_sum(form) == 0:
        own = permute_digits(form[:11], key)
        return _refill(value, own + next(d for d in "0123456789" if check_sum(own + d) == 0))
    k = 2 if form[:2].isalpha() and form[2:].isdigit() else 0  # a state code
    return _refill(value, form[:k] + _permuted_form(form[k:], key))


def date_pseudonym(value: str, key: bytes) -> str | None:
    """A date of the years 1900 to 2099 in the same format, or None if there is no such day."""
    m = DATE.fullmatch(value)
    parts = (m["y"], m["m"], m["d"]) if m and m["y"] else (m["y2"], m["m2"], m["d2"]) if m else None
    low, high = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    try:
        day = datetime.date(*map(int, parts)).toordinal() - low
    except (TypeError, ValueError):
        return None
    new = datetime.date.fromordinal(permute(day, high - low + 1, key) + low)
    digit = lambda s, x: "".join(chr(ord(c) - int(c) + int(d)) for c, d in zip(s, str(x).zfill(len(s)))) if len(str(x)) <= len(s) else str(x)
    spans = sorted((m.span(g), digit(m[g], x)) for g, x in (("y" if m["y"] else "y2", new.year), ("m" if m["y"] else "m2", new.month), ("d" if m["y"] else "d2", new.day)))
    out, end = [], 0
    for (a, b), t in spans:
        out += [value[end:a], t]
        end = b
    return "".join(out) + value[end:]


_AT = regex.compile(r" ?(?:@|[(\[]at[)\]]| at ) ?", regex.I)
_DOT = regex.compile(r" ?[(\[]dot[)\]] ?| dot |\.", regex.I)


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The placeholder of a value."""
    if kind in ("phone", "id_number"):
        return f"<{kind}:{number_pseudonym(kind, value, key)}>"
    if kind == "date":
        return f"<date:{date_pseudonym(value, key) or value}>"
    folded = plain_map(value)[0].lower()
    folded = _DOT.sub(".", _AT.sub("@", folded)) if kind == "email" else " ".join(_TOKENS.findall(folded))
    return f"<{kind}:" + hmac.new(key, f"{kind}|{folded}".encode(), hashlib.sha256).hexdigest()[:20] + ">"


_TOKENS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def _words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, first, later, titled, n) of texts and their person spans, added up within the batch."""
    for b in it:
        c: dict[str, list[int]] = {}
        for text, people in zip(b.column("text").to_pylist(), b.column("people").to_pylist()):
            before = ""
            for w in _WORDS.findall(plain_map(text)[0].lower()) if text else ():
                x = c.setdefault(w, [0, 0, 0, 0])
                x[2] += before in TITLES
                x[3] += 1
                before = w
            for p in people or ():
                for i, w in enumerate(x for x in _WORDS.findall(plain_map(p or "")[0].lower()) if len(x) > 1):
                    c.setdefault(w, [0, 0, 0, 0])[min(i, 1)] += 1
        cols = list(zip(*c.values())) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *(pa.array(x, pa.int64()) for x in cols)], names=["word", "n0", "n1", "n2", "n3"])


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        at = np.array([_places(w) for w in b.column("word").to_pylist()], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(at.T.reshape(-1)), *(pa.concat_arrays([b.column(f"n{i}")] * 2) for i in range(4))], names=["place", "n0", "n1", "n2", "n3"])


def name_table(annotated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts (first in a person span, later in one, after a title, in all) of words. Only places with a word
    that may be a name are kept: a place without spans and titles says no name, as a missing one does."""
    people = F.transform(F.filter("ner_spans", lambda p: p["entity_type"] == "PER"), lambda p: p["text"])
    w = annotated.select("text", people.alias("people")).mapInArrow(_words, "word string, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
    w = w.groupBy("word").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4)))
    t = w.mapInArrow(_hashed, "place bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint").groupBy("place").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4)))
    t = t.where("n0 + n1 + n2 > 0").toArrow().sort_by("place")
    counts = np.stack([t.column(f"n{i}").to_numpy() for i in range(4)], 1).astype(np.float64) if t.num_rows else np.zeros((0, 4))
    return t.column("place").to_numpy(), counts


_kept: dict[int, tuple[tuple, Names]] = {}


def _names(table: tuple) -> Names:
    """One for each table in a worker."""
    if id(table) not in _kept:
        _kept.clear()
        _kept[id(table)] = table, Names(table)  # the table is kept, so that no other gets its id
    return _kept[id(table)][1]


_FINDS = "record_id string, kind string, start_at int, end_at int, pseudonym string"


def _find(it: Iterator[pa.RecordBatch], table: tuple, key: bytes, dates: bool) -> Iterator[pa.RecordBatch]:
    names = _names(table)
    for batch in it:
        rows = [(k, kind, a, b, pseudonym(kind, t[a:b], key)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for kind, a, b in finds(t, names, dates)]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["record_id", "kind", "start_at", "end_at", "pseudonym"])


def hidden(text: str | None, names: Names, key: bytes, dates: bool = False) -> str | None:
    """The text with a placeholder for each find and nothing else changed."""
    if not text:
        return text
    out, end = [], 0
    for kind, a, b in finds(text, names, dates):
        out += [text[end:a], pseudonym(kind, text[a:b], key)]
        end = b
    return "".join(out) + text[end:]


def _hide(it: Iterator[pa.RecordBatch], table: tuple, key: bytes, dates: bool) -> Iterator[pa.RecordBatch]:
    names = _names(table)
    for batch in it:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hidden(t, names, key, dates) for t in batch.column(1).to_pylist()], pa.string())], names=["record_id", "text"])


def private_finds(records: DataFrame, annotated: DataFrame, key: bytes, dates: bool = False) -> DataFrame:
    """(record_id, kind, start_at, end_at, pseudonym) of each find in ``records`` (record_id, text)."""
    table = records.sparkSession.sparkContext.broadcast(name_table(annotated))
    return records.select("record_id", "text").mapInArrow(lambda it: _find(it, table.value, key, dates), _FINDS)


def redact(records: DataFrame, annotated: DataFrame, key: bytes, dates: bool = False) -> DataFrame:
    """``records`` (record_id, text) with placeholders in the texts."""
    table = records.sparkSession.sparkContext.broadcast(name_table(annotated))
    return records.select("record_id", "text").mapInArrow(lambda it: _hide(it, table.value, key, dates), "record_id string, text string")


def _records(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, bytes]:
    a = s.read.parquet(f"{d}/annotated_sentences.parquet")
    docs = s.read.parquet(f"{d}/documents.parquet")
    rec = a.select(F.col("sentence_id").alias("record_id"), "text").unionByName(docs.select(F.col("doc_id").cast("string").alias("record_id"), "text"))
    return rec, a, s.conf.get("spark.corpuskit.key", DEFAULT_KEY).encode()


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return private_finds(*_records(s, d)).select("record_id", "kind", "start_at").distinct()


def p6_links(s: SparkSession, d: str) -> DataFrame:
    """Values that stand in more than one record, by their pseudonyms: finds and records of each."""
    f = private_finds(*_records(s, d)).groupBy("kind", "pseudonym", "record_id").agg(F.count("*").alias("n"))
    return f.groupBy("kind", "pseudonym").agg(F.sum("n").alias("finds"), F.count("*").alias("records")).where("records > 1")


def p6_texts(s: SparkSession, d: str) -> DataFrame:
    return redact(*_records(s, d))
