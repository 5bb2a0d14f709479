"""Lexicon taggers and keyword predictors: one expression a record, no shuffle, no Python. Lexicons are arguments.

Tokens are white-space tokens as they stand: punctuation is not stripped from them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.labels import SPAN
from corpuskit.functions.text import let, script, token_places, tokens

# The confidence of each way a language is found.
CONFIDENCE = {"RAJ": 0.90, "HIN": 0.80, "ENG": 0.95, "TRL": 0.75, "other": 0.60}


def _in(t: Column, words: Iterable[str]) -> Column:
    w = sorted(set(words))
    return t.isin(*w) if w else F.lit(False)


def languages(text: str | Column, rajasthani: Iterable[str], english: Iterable[str]) -> Column:
    """array<struct<token, label, confidence>>: by script, then by lexicon; Rajasthani words are met as they stand, English
    ones in lower case; tokens of no script are HIN."""

    def label(t: Column) -> Column:
        s = script(t)
        name = F.when(s == "devanagari", F.when(_in(t, rajasthani), "RAJ").otherwise("HIN")).when(s == "latin", F.when(_in(F.lower(t), english), "ENG").otherwise("TRL")).otherwise("HIN")
        sure = F.when(s == "other", CONFIDENCE["other"]).when(name == "RAJ", CONFIDENCE["RAJ"]).when(name == "HIN", CONFIDENCE["HIN"]).when(name == "ENG", CONFIDENCE["ENG"]).otherwise(CONFIDENCE["TRL"])
        return F.struct(t.alias("token"), name.alias("label"), sure.alias("confidence"))

    return F.transform(tokens(text), label)


def with_languages(text: str | Column, labels: Column) -> Column:
    """The text with ``[LABEL]`` before each token."""
    return F.array_join(F.flatten(F.transform(labels, lambda x: F.array(F.concat(F.lit("["), x["label"], F.lit("]")), x["token"]))), " ")


def keyword_hits(text: str | Column, keywords: Iterable[str]) -> Column:
    """Distinct keywords among the tokens, as they stand or in lower case."""
    words = sorted(set(keywords))
    if not words:
        return F.lit(0)
    text = F.col(text) if isinstance(text, str) else text
    all_ = F.array_union(tokens(text), tokens(F.lower(text)))
    return F.coalesce(F.size(F.filter(all_, lambda t: t.isin(*words))), F.lit(0))


def sentiment(text: str | Column, positive: Iterable[str], negative: Iterable[str]) -> Column:
    """struct<label, confidence, positive, neutral, negative> from keyword hits; ties and no hits are neutral."""
    text = F.col(text) if isinstance(text, str) else text

    def scored(h: Column) -> Column:
        p, n = h["p"], h["n"]
        won = F.lit(0.5) + F.lit(0.4) * (F.greatest(p, n) / (p + n + 1))
        rest = (1 - won) / 2
        pos = F.when(p + n == 0, 0.2).when(p > n, won).when(n > p, rest).otherwise(0.25)
        neg = F.when(p + n == 0, 0.2).when(n > p, won).when(p > n, rest).otherwise(0.25)
        neu = F.when(p + n == 0, 0.6).when(p == n, 0.5).otherwise(rest)
        label = F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")
        sure = F.when(p > n, pos).when(n > p, neg).otherwise(neu)
        return F.struct(label.alias("label"), sure.alias("confidence"), pos.alias("positive"), neu.alias("neutral"), neg.alias("negative"))

    return let(text, lambda t: let(F.struct(keyword_hits(t, positive).alias("p"), keyword_hits(t, negative).alias("n")), scored))


def sentiment_with_languages(text: str | Column, positive: Iterable[str], negative: Iterable[str], rajasthani: Iterable[str], english: Iterable[str]) -> Column:
    return sentiment(with_languages(text, languages(text, rajasthani, english)), positive, negative)


def toxicity(text: str | Column, keywords: dict[str, Iterable[str]], threshold: float = 0.5) -> Column:
    """struct<labels, scores map>: of each category the hits over a fifth of its keywords, at most 1; labels in the order of
    ``keywords`` from ``threshold`` on."""
    score = {c: F.least(F.lit(1.0), keyword_hits(text, k) / F.lit(max(1.0, len(set(k)) * 0.2))) if len(set(k)) else F.lit(0.0) for c, k in keywords.items()}
    labels = F.array_compact(F.array(*(F.when(s >= threshold, F.lit(c)) for c, s in score.items())))
    return F.struct(labels.alias("labels"), F.create_map(*(x for c, s in score.items() for x in (F.lit(c), s))).alias("scores"))


def phrases(entries: Iterable[tuple[tuple[str, ...], str]]) -> dict[str, list[tuple[tuple[str, ...], str]]]:
    """Phrases by first token, the longest first; of equal length the one listed first."""
    out: dict[str, list] = {}
    for phrase, kind in entries:
        out.setdefault(phrase[0], []).append((tuple(phrase), kind))
    return {k: sorted(v, key=lambda x: -len(x[0])) for k, v in out.items()}


def entities(text: str | Column, entries: Iterable[tuple[tuple[str, ...], str]]) -> Column:
    """array<struct<start, end, entity_type, text>>: from left to right the longest phrase that begins at a token, then on
    behind it."""
    text = F.col(text) if isinstance(text, str) else text
    listed = [e for group in phrases(entries).values() for e in group]
    if not listed:
        return F.array().cast(f"array<{SPAN}>")
    by_length: dict[int, dict[str, list[str]]] = {}
    for phrase, kind in listed:
        joined = " ".join(phrase)
        lengths = by_length.setdefault(len(phrase), {})
        if not any(joined in words for words in lengths.values()):
            lengths.setdefault(kind, []).append(joined)
    kind = "array<struct<first:int,n:int,kind:string>>"

    def at(toks: Column, i: Column) -> Column:
        found = None
        for n in sorted(by_length, reverse=True):
            here = F.array_join(F.transform(F.slice(toks, i + 1, F.lit(n)), lambda t: t["token"]), " ")
            for kind, words in by_length[n].items():
                hit = here.isin(*sorted(words))
                v = F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"))
                found = F.when(hit, v) if found is None else found.when(hit, v)
        return found

    def scan(hits: Column) -> Column:
        return F.aggregate(
            hits,
            F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("out")),
            lambda acc, m: F.when(m["hit"].isNotNull() & (m["i"] >= acc["free"]), F.struct((m["i"] + m["hit"]["n"]).alias("free"), F.concat(acc["out"], F.array(F.struct(m["i"].alias("first"), m["hit"]["n"].alias("n"), m["hit"]["kind"].alias("kind")))).alias("out"))).otherwise(acc),
            lambda acc: acc["out"],
        )

    def spans(toks: Column) -> Column:
        hits = F.filter(F.transform(toks, lambda t, i: F.struct(i.alias("i"), at(toks, i).alias("hit"))), lambda m: m["hit"].isNotNull())
        start, end = (lambda p: F.get(toks, p["first"])["start"]), (lambda p: F.get(toks, p["first"] + p["n"] - 1)["end"])
        return F.transform(scan(hits), lambda p: F.struct(start(p).alias("start"), end(p).alias("end"), p["kind"].alias("entity_type"), F.substring(text, start(p) + 1, end(p) - start(p)).alias("text")))

    return let(token_places(text), spans)


def bio_tags(text: str | Column, spans: str | Column) -> Column:
    """A tag a token: those inside a span by their places are B- (the first) and I-; a later span overwrites."""
    spans = F.col(spans) if isinstance(spans, str) else spans

    def tags(toks: Column) -> Column:
        def tag(t: Column) -> Column:
            def named(last: Column) -> Column:
                first = F.size(F.filter(toks, lambda u: (u["start"] >= last["start"]) & (u["end"] <= last["end"]) & (u["start"] < t["start"]))) == 0
                return F.when(last.isNull(), "O").otherwise(F.concat(F.when(first, "B-").otherwise("I-"), last["entity_type"]))

            return let(F.try_element_at(F.filter(F.coalesce(spans, F.array().cast(f"array<{SPAN}>")), lambda p: (t["start"] >= p["start"]) & (t["end"] <= p["end"])), F.lit(-1)), named)

        return F.transform(toks, tag)

    return let(token_places(text), tags)


def bio_spans(text: str | Column, tags: str | Column) -> Column:
    """Spans of a tag sequence: a B- begins one, an I- of the same type goes on with it, any other tag ends it; an I-
    without a span of its type before it is nothing."""
    text, tags = F.col(text) if isinstance(text, str) else text, F.col(tags) if isinstance(tags, str) else tags
    kind = "array<struct<start:int,end:int,entity_type:string>>"
    empty = F.lit(None).cast("struct<start:int,end:int,entity_type:string>")
    both = F.zip_with(token_places(text), tags, lambda t, g: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.coalesce(g, F.lit("O")).alias("tag")))
    both = F.filter(both, lambda x: x["start"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        what = F.substring(x["tag"], 3, 100)
        goes_on = F.startswith(x["tag"], F.lit("I-")) & (acc["open"]["entity_type"] == what)
        longer = F.struct(acc["open"]["start"].alias("start"), x["end"].alias("end"), acc["open"]["entity_type"].alias("entity_type"))
        new = F.when(F.startswith(x["tag"], F.lit("B-")), F.struct(x["start"].alias("start"), x["end"].alias("end"), what.alias("entity_type"))).otherwise(empty)
        done = F.when(acc["open"].isNotNull(), F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])
        return F.when(F.coalesce(goes_on, F.lit(False)), F.struct(longer.alias("open"), acc["out"].alias("out"))).otherwise(F.struct(new.alias("open"), done.alias("out")))

    spans = F.aggregate(both, F.struct(empty.alias("open"), F.array().cast(kind).alias("out")), step, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"]))
    return F.transform(spans, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["entity_type"].alias("entity_type"), F.substring(text, p["start"] + 1, p["end"] - p["start"]).alias("text")))


def as_annotated(raw: DataFrame, split: str, rajasthani: Iterable[str], english: Iterable[str]) -> DataFrame:
    """Raw records with placeholder annotations (neutral by three annotators, no spans, no categories) and language tags."""
    span = f"array<{SPAN}>"
    return raw.select(
        "sentence_id", "text", "platform", F.lit(split).alias("split"), F.lit("neutral").alias("sentiment"), F.array_repeat(F.lit("neutral"), 3).alias("sentiment_annotator_labels"),
        F.array().cast(span).alias("ner_spans"), F.array_repeat(F.array().cast(span), 3).alias("ner_annotator_spans"), F.array().cast("array<string>").alias("toxicity_labels"),
        F.array_repeat(F.array().cast("array<string>"), 3).alias("toxicity_annotator_labels"), languages("text", rajasthani, english).alias("token_language_labels"), "source_url", "collected_at", F.col("collected_at").alias("annotated_at"),
    )


def predictor(df: DataFrame, predict, schema: str) -> DataFrame:
    """A model's predictions for batches: ``predict`` takes and gives an iterator of pandas frames (loaded once a task)."""
    return df.mapInPandas(predict, schema)
