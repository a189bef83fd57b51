"""Links of pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import EXCLUDES
from corpusloom.functions import urls

HREF = r'(?i)<a\s[^>]*?href="([^"]*)"'
_ATTRIBUTE = {"a": "href", "link": "href", "img": "src", "script": "src"}


def hrefs(html: Column) -> Column:
    """The distinct values of ``href`` of anchors, by pattern: the fast path, for markup with quoted attributes."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(HREF), 1))


#: Elements whose text isn't a page's own, elements that end a line, and those that hold the body where a page has them.
_OUT = frozenset("script style noscript template nav header footer aside head title".split())
_LINE = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 tr table section article main body br blockquote button dl dt dd pre figure figcaption form hr".split())
_BODY = frozenset(("article", "main"))
_EMPTY = frozenset("br hr img input meta link".split())


class _Collector(HTMLParser):
    """Links and lines of text of a page, in one pass."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.base: str | None = None
        self.out, self.body, self.seen_body = 0, 0, False
        self.parts: list[str] = []
        self.lines: list[tuple[str, bool]] = []  # text, whether it lies in an article or main element

    def flush(self):
        if self.parts:
            if line := " ".join("".join(self.parts).split()):
                self.lines.append((line, self.body > 0))
            self.parts.clear()

    def handle_starttag(self, tag, attrs):
        if tag == "base" and self.base is None:
            self.base = dict(attrs).get("href")
        elif (name := _ATTRIBUTE.get(tag)) and (value := dict(attrs).get(name)) is not None:
            self.found.append((tag, value))
        if tag in _LINE:
            self.flush()
        elif tag in ("td", "th") and self.parts:
            self.parts.append(" | ")
        if tag in _OUT:
            self.flush()
            self.out += 1
        elif tag in _BODY:
            self.body, self.seen_body = self.body + 1, True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _LINE or tag in _OUT:
            self.flush()
        if tag in _OUT:
            self.out = max(0, self.out - 1)
        elif tag in _BODY:
            self.body = max(0, self.body - 1)

    def handle_data(self, data):
        if not self.out:
            self.parts.append(data)

    def text(self) -> str | None:
        """The lines of the article or main element, if there is one with text, else of the page; a line that stands again comes out once. Null where nothing is left."""
        self.flush()
        own = [x for x, inside in self.lines if inside] or [x for x, _ in self.lines]
        return "\n".join(dict.fromkeys(own)) or None


def parse_page(html: str | None, url: str) -> tuple[list[tuple[str, str]], str | None]:
    """((tag, absolute url), ...) and the text of a page by one full parse, with its base element; a link that can't be resolved is skipped, the rest stays."""
    c = _Collector()
    try:
        c.feed(html or "")
        c.close()
    except Exception:  # broken markup: what was found so far
        pass
    out = []
    for tag, value in c.found:
        try:
            base = urljoin(url, c.base) if c.base else url
            out.append((tag, urljoin(base, value.strip())))
        except ValueError:
            continue
    return out, c.text()


def page_links(html: str | None, url: str) -> list[tuple[str, str]]:
    """The links of ``parse_page``."""
    return parse_page(html, url)[0]


def parsed_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` (with url) and ``links``, the distinct (tag, abs_url) of each page, and ``text``, its own text or null: one parse for both, in Arrow batches. Columns of these names are replaced."""
    keep = [c for c in pages.columns if c not in ("links", "text")]
    source = pages.select(*keep)
    schema = source.withColumn("links", F.lit(None).cast("array<struct<tag:string,abs_url:string>>")).withColumn("text", F.lit(None).cast("string")).schema
    kind = pa.list_(pa.struct([("tag", pa.string()), ("abs_url", pa.string())]))
    place = (keep.index("url"), keep.index(html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_page(html, url or "") for url, html in zip(*(b.column(k).to_pylist() for k in place))]
            links = pa.array([[{"tag": t, "abs_url": u} for t, u in dict.fromkeys(x)] for x, _ in got], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, links, pa.array([t for _, t in got], pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def parsed_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html_content") -> DataFrame:
    """(id, url, tag, abs_url): all links of pages by a full parse, in Arrow batches; once for each page."""
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, tags, links = [], [], []
            for k, (url, html) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for tag, link in dict.fromkeys(page_links(html, url or "")):
                    at.append(k)
                    tags.append(tag)
                    links.append(link)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_pydict({"id": b.column(0).take(at), "url": b.column(1).take(at), "tag": pa.array(tags, pa.string()), "abs_url": pa.array(links, pa.string())})

    return source.mapInArrow(run, "id long, url string, tag string, abs_url string")


def admitted(tag: Column, link: Column, domain: Column, excludes: tuple[str, ...] = EXCLUDES, strict: bool = False) -> Column:
    """Whether a normalised link is followed: anchors within the domain that aren't excluded, and of link, script and img those to files, on any domain unless ``strict``."""

    def of(link_: Column) -> Column:
        own = urls.netloc(link_) == domain
        asset = tag.isin("link", "script", "img") & urls.downloadable(link_)
        return F.startswith(link_, F.lit("http")) & (((tag == "a") & own & ~urls.excluded(link_, excludes)) | (asset & own if strict else asset))

    return F.coalesce(urls.let(link, of), F.lit(False))
