"""Pages and search: what collectors compute, over dumps of pages and of search answers. Fetching is the caller's."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


LEAST = 10
# What marks an error page, and where posts' texts stand, best place first.
ERROR_MARKS = ("404", "not found", "page not found", "error", "403", "forbidden", "500", "502", "503", "service unavailable")
PLACES = (".share-chat-post", "[data-testid='post-text']", "p", "div")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_LINES = {"p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"}


class _Page(HTMLParser):
    """Title, visible text of the body, and the text of every element that is one of the places."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.body = "", []
        self.open: list[tuple[str, list[str] | None]] = []
        self.found: dict[str, list[list[str]]] = {p: [] for p in PLACES}
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _LINES:
            self._add("\n")
        if tag in _VOID:
            return
        buf: list[str] | None = None
        for p in PLACES:
            if p == tag or (p == PLACES[0] and "share-chat-post" in (a.get("class") or "").split()) or (p == PLACES[1] and a.get("data-testid") == "post-text"):
                buf = [] if buf is None else buf
                self.found[p].append(buf)
        self.hidden += tag in ("script", "style", "template", "noscript")
        self.open.append((tag, buf))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.hidden -= sum(t in ("script", "style", "template", "noscript") for t, _ in self.open[i:])
                del self.open[i:]
                break
        if tag in _LINES:
            self._add("\n")

    def _add(self, text):
        if self.hidden:
            return
        if any(t == "title" for t, _ in self.open):
            self.title += text
            return
        self.body.append(text)
        for _, buf in self.open:
            if buf is not None:
                buf.append(text)

    def handle_data(self, data):
        self._add(data)


def parse_page(html: str | None) -> tuple[str, str, list[str]]:
    """Title, body text and the texts of at least ``LEAST`` characters of the first place that has any. Broken pages are
    read as far as they go; null is an empty page."""
    p = _Page()
    if html:
        p.feed(html)
        p.close()
    tidy = lambda parts: "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)
    for place in PLACES:
        texts = [t for t in map(tidy, p.found[place]) if len(t) >= LEAST]
        if texts:
            return p.title.strip(), tidy(p.body), texts
    return p.title.strip(), tidy(p.body), []


_PARTS = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("texts", T.ArrayType(T.StringType()))])


@F.pandas_udf(_PARTS)
def _page(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(h) for h in html], columns=["title", "body", "texts"])


def is_error(title: Column, body: Column) -> Column:
    """Whether the title, or the first 500 characters of the body, has one of the marks, anywhere in it."""
    seen = lambda c: F.exists(F.array(*map(F.lit, ERROR_MARKS)), lambda m: F.contains(F.lower(F.coalesce(c, F.lit(""))), m))
    return seen(title) | seen(F.substring(body, 1, 500))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, place, text): the posts of pages (page_id, url, html) that are no error pages, in page order."""
    p = pages.select("page_id", "url", _page("html").alias("p")).where(~is_error(F.col("p.title"), F.col("p.body")))
    return p.select("page_id", "url", F.posexplode("p.texts").alias("place", "text"))


def page_errors(pages: DataFrame) -> DataFrame:
    """(page_id, is_error)."""
    p = pages.select("page_id", _page("html").alias("p"))
    return p.select("page_id", is_error(F.col("p.title"), F.col("p.body")).alias("is_error"))


def page_records(pages: DataFrame) -> DataFrame:
    """Posts of pages as raw records; ids come from address and text."""
    t = page_texts(pages)
    return t.select(F.md5(F.concat_ws("|", "url", "text")).alias("sentence_id"), "text", F.col("url").alias("source_url"), F.lit("sharechat").alias("platform"), F.current_timestamp().alias("collected_at"))


def collect_pages(urls: list[str], fetch, timeout: float = 10.0) -> list[tuple[int, str, str]]:
    """(page_id, url, html) by ``fetch(url, timeout)``: after a TimeoutError once more with twice the time; pages that
    fail are left out. For ``createDataFrame`` and ``page_texts``."""
    out = []
    for i, u in enumerate(urls):
        for t in (timeout, 2 * timeout):
            try:
                out.append((i, u, fetch(u, t)))
                break
            except TimeoutError:
                continue
            except Exception:
                break
    return out


def search_query(terms: DataFrame, term: str = "term", order: str = "ord") -> DataFrame:
    """(query): the terms joined by OR, those of several words in quotes, repeats of posts left out. Blank terms do not
    count. One row a term reaches the aggregate, a search has few."""
    t = F.trim(F.col(term))
    q = terms.where(t != "").select(order, F.when(F.contains(t, F.lit(" ")) & ~F.startswith(t, F.lit('"')), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "t"))), lambda x: x["t"]), " OR ")
    return q.agg(F.concat(F.lit("("), joined, F.lit(") -is:retweet")).alias("query"))


def search_records(posts: DataFrame, most: int | None = None, order: str = "seq") -> DataFrame:
    """Posts of search answers (seq, id, text, author_id) as raw records, the first ``most`` in order if given."""
    p = posts if most is None else posts.orderBy(order).limit(most)
    url = F.concat(F.lit("https://twitter.com/i/web/status/"), F.col("id").cast("string"))
    return p.select(F.md5(url).alias("sentence_id"), "text", url.alias("source_url"), F.lit("twitter").alias("platform"), F.current_timestamp().alias("collected_at"))


def page_size(wanted: int) -> int:
    """Posts to ask for at once: 10 to 100."""
    return min(100, max(10, wanted))


def wait_seconds(retry_after: str | Column, reset: str | Column, now: str | Column) -> Column:
    """Seconds to wait after a refusal: what the answer says, else until the reset, else 60; at least 1 if it is told."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    told = F.coalesce(c(retry_after).try_cast("int"), c(reset).try_cast("int") - c(now))
    return F.when(told.isNull(), 60).otherwise(F.greatest(F.lit(1), told))


class SearchRefused(RuntimeError):
    """The search answered 401 or 403."""


def search_pages(search, query: str, most: int, sleep) -> list[dict]:
    """Posts of ``search(query, size, token)`` -> (status, headers, posts, next token), page by page until ``most`` or no
    token is left; a 429 waits and asks again."""
    import time

    out: list[dict] = []
    token = None
    while len(out) < most:
        status, headers, posts, following = search(query, page_size(most - len(out)), token)
        if status in (401, 403):
            raise SearchRefused(str(status))
        if status == 429:
            told = headers.get("Retry-After") or (int(headers["x-rate-limit-reset"]) - int(time.time()) if "x-rate-limit-reset" in headers else 60)
            sleep(max(1, int(told)))
            continue
        out += posts
        token = following
        if not token:
            break
    return out[:most]


def catalog(spark: SparkSession, kinds: dict[str, list[str]]) -> DataFrame:
    """(kind, ord, term) of search terms and addresses, given as lists."""
    return spark.createDataFrame([(k, i, t) for k, ts in kinds.items() for i, t in enumerate(ts)], "kind string, ord int, term string")
