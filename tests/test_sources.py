import json

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import filters
from corpuskit.plans import pipeline
from corpuskit.sources import files, web
from corpuskit.streaming import streams
from tests.test_operators import ANN, annotated


def test_manual_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿text,source_url,platform,notes\n"first, record text",http://x,Twitter,n\nshort,,,\n"two\nlines here",,whatsapp,\nvery long second text\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv")).orderBy("seq").collect()
    assert [(r.text, r.source_url, r.platform) for r in got] == [("first, record text", "http://x", "twitter"), ("two\nlines here", "manual://whatsapp", "twitter"), ("very long second text", "manual://other", "twitter")]
    assert len({r.sentence_id for r in got}) == 3
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "a.json").write_text(json.dumps([{"text": "a long enough text", "platform": "sharechat"}, 5, "x", {"text": 1234567890123}]))
    assert sorted((r.text, r.platform) for r in files.read_json(spark, str(tmp_path / "a.json")).collect()) == [("1234567890123", "twitter"), ("a long enough text", "sharechat")]
    (tmp_path / "b.json").write_text('{"text": "x"}')
    with pytest.raises(ValueError):
        files.read_json(spark, str(tmp_path / "b.json"))
    (tmp_path / "a.txt").write_text("# comment line\n\n  a long enough line  \nshort\n")
    assert [r.text for r in files.read_text(spark, str(tmp_path / "a.txt"), "sharechat").collect()] == ["a long enough line"]
    with pytest.raises(ValueError):
        pipeline.source(spark, "x.doc")


def test_raw_files_merge(spark, tmp_path):
    rows = lambda *r: "\n".join(json.dumps(dict(zip(("sentence_id", "text", "platform", "collected_at"), x))) for x in r)
    (tmp_path / "1.jsonl").write_text(rows(("a", "one", "twitter", "2024-01-15T10:30:00Z"), ("b", "two", "twitter", "2024-01-15T10:30:00Z")))
    (tmp_path / "2.jsonl").write_text(rows(("b", "other", "twitter", None), ("c", "three", "twitter", None)))
    paths = [str(tmp_path / f"{i}.jsonl") for i in (1, 2, 3)]
    got = files.merge_raw(spark, paths, str(tmp_path / "out"))
    assert sorted((r.sentence_id, r.text, r.source_url) for r in got.collect()) == [("a", "one", ""), ("b", "two", ""), ("c", "three", "")]
    assert sorted(tuple(r) for r in files.read_raw(spark, str(tmp_path / "out")).select("sentence_id", "collected_at").collect()) == sorted(tuple(r) for r in got.select("sentence_id", "collected_at").collect())
    assert files.merge_raw(spark, paths[2:]).count() == 0


def test_annotated_files(spark, tmp_path):
    df = spark.createDataFrame([annotated(), annotated(sentence_id="2", text="é x", ner_spans=None, split="test")], ANN)
    for fmt in files.FORMATS:
        path = str(tmp_path / fmt)
        files.write_annotated(df, path, fmt, by_split=fmt == "parquet")
        back = {r.sentence_id: r for r in files.read_annotated(spark, path, fmt).collect()}
        assert back["s1"].ner_spans == df.where("sentence_id = 's1'").first().ner_spans and back["2"].text == "é x" and back["2"].ner_spans == [] and str(back["2"].collected_at) == "2024-01-15 10:30:00"
    for f in (lambda: files.write_annotated(df, "x", "xml"), lambda: files.read_annotated(spark, "x", "xml")):
        with pytest.raises(ValueError, match="xml"):
            f()
    with pytest.raises(FileNotFoundError):
        files.load_corpus(spark, str(tmp_path))
    files.write_annotated(df, str(tmp_path / "corpus.jsonl"))
    assert {k: v.count() for k, v in files.load_corpus(spark, str(tmp_path)).items()} == {"train": 1, "validation": 0, "test": 1}
    j = json.loads(files.as_json(df).first().json)
    assert j["ner_spans"][0]["text"] == "Gehlot" and j["collected_at"].startswith("2024-01-15T10:30:00")
    assert json.loads(files.annotation_tasks(df).first().value)["data"]["text"] == "Gehlot Jaipur me"


PAGE = "<html><head><title>{t}</title><script>var p = '</p><p>not shown at all</p>';</script></head><body>{b}</body></html>"


def test_pages(spark):
    long = "a text that is long enough"
    pages = [
        (1, "u1", PAGE.format(t="x", b=f"<p>{long} &amp; more</p><p>short</p><div>ignored because p has texts</div>")),
        (2, "u2", PAGE.format(t="404 Not Found", b=f"<p>{long}</p>")), (3, "u3", PAGE.format(t="x", b=f"<div>service unavailable</div><p>{long}</p>")),
        (4, "u4", PAGE.format(t="x", b=f"<p>{long}</p><div class='a share-chat-post'>the post itself <b>bold</b></div>")), (5, "u5", PAGE.format(t="x", b="<div>only a division here")), (6, "u6", None),
        (7, "u7", PAGE.format(t="x", b=f"<span data-testid='post-text'>by test id, ten</span><p>{long}</p>")), (8, "u8", PAGE.format(t="A terror report", b=f"<p>{long}</p>")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r.page_id, r.place, r.text) for r in web.page_texts(df).orderBy("page_id", "place").collect()]
    assert got == [(1, 0, long + " & more"), (4, 0, "the post itself bold"), (5, 0, "only a division here"), (7, 0, "by test id, ten")]
    assert [r.page_id for r in web.page_errors(df).where("is_error").collect()] == [2, 3, 8]
    assert web.page_records(df).count() == 4

    def fetch(u, t):
        if u == "slow" and t < 15:
            raise TimeoutError
        if u == "bad":
            raise OSError
        return f"<p>{u}</p>"

    assert [p[1] for p in web.collect_pages(["a", "slow", "bad"], fetch)] == ["a", "slow"]


def test_search(spark):
    t = spark.createDataFrame([(2, "#x"), (1, "two words"), (3, ' "kept as is" '), (4, "")], "ord int, term string")
    assert web.search_query(t).first().query == '("two words" OR #x OR "kept as is") -is:retweet'
    w = spark.createDataFrame([("30", None, 0), (None, "100", 40), (None, None, 0), ("0", None, 0), ("x", None, 0)], "a string, b string, now int").select(web.wait_seconds("a", "b", "now").alias("w"))
    assert [r.w for r in w.collect()] == [30, 60, 60, 1, 60]
    answers = iter([(429, {"Retry-After": "7"}, [], None), (200, {}, [{"id": 1}] * 10, "n"), (200, {}, [{"id": 2}] * 10, None)])
    waits = []
    assert len(web.search_pages(lambda *a: next(answers), "q", 15, waits.append)) == 15 and waits == [7]
    with pytest.raises(web.SearchRefused):
        web.search_pages(lambda *a: (401, {}, [], None), "q", 5, waits.append)
    assert [web.page_size(n) for n in (1, 50, 500)] == [10, 50, 100]
    posts = spark.createDataFrame([(i, i + 100, f"t{i}", None) for i in range(5)], "seq int, id long, text string, author_id long")
    assert web.search_records(posts, 2).count() == 2 and web.search_records(posts, 1).first().source_url.endswith("/100")
    assert web.catalog(spark, {"tag": ["a", "b"]}).count() == 2


def test_pipeline(spark, tmp_path):
    s = pipeline.Settings(lexicon=("aa", "bb", "cc"), positive=("aa",), negative=("bb",), english=("the",), keywords={"general": ("cc",)}, entities=((("dd",), "PER"),), sample=40)
    raw = files.template_records(spark, 100, ["the {w1} went with {w2} to the market {w1}", "no word of it here {w2}", "{w1} {w2} and dd talked for a while about rain"], ["aa", "bb", "cc", "zz", "yy"])
    assert raw.select("text").distinct().count() == 15
    got = pipeline.run(spark, raw, str(tmp_path), s)
    counts = {r.split: r["count"] for r in got["annotated"].groupBy("split").count().collect()}
    n = sum(counts.values())
    assert 0 < n < 15 and counts["train"] == n - 2 * sum(int(k * 0.1) for k in ()) - counts.get("test", 0) - counts.get("validation", 0)
    assert got["errors"].count() == 0 and got["scores"].count() == 3 and got["table"].count() == 4 and got["statistics"].count() > 0
    assert files.read_annotated(spark, f"{tmp_path}/corpus.parquet", "parquet").count() == n
    assert files.publish(["a"], got["gate"], lambda p: None) == []
    ok = filters.release_gate(spark.createDataFrame([("ner", 0.9)], "task string, macro_f1 double"), {"ner": 0.9})
    sent = []
    assert files.publish(["a", "b"], ok, sent.append) == sent == ["a", "b"]


def test_streams(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [("é x", at), ("é x", at), ("other", at), (None, at)]
    spark.createDataFrame(rows, "text string, collected_at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string, collected_at timestamp").parquet(f"{tmp_path}/in")
    q = streams.exact_dedup(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
    ev = [(1, at, "x", "expose", 150), (2, at, "x", "expose", 50), (3, at, "y", "expose", 5), (4, at + dt.timedelta(days=9), "z", "expose", 1)]
    spark.createDataFrame(ev, "event_id long, ts timestamp, annotator_id string, kind string, n int").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("event_id long, ts timestamp, annotator_id string, kind string, n int").parquet(f"{tmp_path}/ev")
    q = streams.daily_exposure(stream).writeStream.format("memory").queryName("exposure").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("exposure").collect()) == [("x", "2024-01-01", 200, False), ("y", "2024-01-01", 5, True), ("z", "2024-01-10", 1, True)]
