"""Fetching: from a stored table of pages, or over HTTP."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import CrawlConfig
from corpusloom.functions import urls
from corpusloom.functions.content import charset, decode
from corpusloom.functions.content import kind as kind_of
from corpusloom.operators.text import first_of_each
from corpusloom.plans.storage import materialize

RESPONSE = "netloc string, url string, status int, content_type string, body binary, charset string, attempts int, error string"


class CorpusFetcher:
    """Answers from a table of pages (page_id, url, http_status, content_type, content), by normalised url; of several the least page_id."""

    def __init__(self, pages: DataFrame, tracking: bool = True):
        one = first_of_each(pages.withColumn("__u", urls.normalize(F.col("url"), tracking)), ["__u"], ["page_id"])
        self.pages = one.select(F.col("__u").alias("url"), F.col("http_status").cast("int").alias("status"), "content_type", F.col("content").alias("html"))

    def fetch(self, frontier: DataFrame) -> DataFrame:
        """frontier (netloc, url) -> (netloc, url, status, content_type, html, n_bytes, kind, error): error is ``not found`` where there is no page."""
        j = frontier.join(self.pages, "url", "left")
        found = F.col("html").isNotNull() | F.col("status").isNotNull()
        return j.select("netloc", "url", "status", "content_type", "html", F.octet_length("html").cast("long").alias("n_bytes"), kind_of(F.col("url"), F.col("content_type")).alias("kind"), F.when(~found, F.lit("not found")).alias("error"))


def get(url: str, config: CrawlConfig, opener=None) -> tuple:
    """(status, content_type, body, charset, attempts, error) of one url: up to ``max_retries`` tries with a pause of 1 s, 2 s and so on between; an HTTP status is an answer."""
    opener = opener or urllib.request.build_opener()
    error = ""
    for k in range(1, config.max_retries + 1):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": config.user_agent})
            with opener.open(request, timeout=config.timeout) as r:
                return r.status, r.headers.get_content_type(), r.read(), r.headers.get_content_charset(), k, None
        except urllib.error.HTTPError as e:
            return e.code, e.headers.get_content_type() if e.headers else None, e.read(), None, k, None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if k < config.max_retries:
                time.sleep(k)
    return None, None, None, None, config.max_retries, error


class HttpFetcher:
    """Fetches over HTTP in the executors, in at most ``max_concurrent`` tasks, of a domain at most ``per_host`` of them, with a pause before each request; responses are closed after each; the result is written once before it is used, since a plan may be run twice."""

    def __init__(self, config: CrawlConfig):
        self.config = config

    def fetch(self, frontier: DataFrame) -> DataFrame:
        config = self.config

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opener = urllib.request.build_opener()
            for b in batches:
                for netloc, url in zip(b.column("netloc").to_pylist(), b.column("url").to_pylist()):
                    time.sleep(config.delay)
                    status, ctype, body, cs, n, error = get(url, config, opener)
                    row = (netloc, url, status, ctype, body, cs, n, error)
                    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.string())
                    names = [x.split()[0] for x in RESPONSE.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        parts = max(1, min(config.max_concurrent, 1000))
        rows = materialize(frontier.select("netloc", "url").repartition(parts, "netloc", F.pmod(F.hash("url"), F.lit(max(1, config.per_host)))).mapInArrow(run, RESPONSE), "fetched")
        k = kind_of(F.col("url"), F.col("content_type"))
        return rows.select("netloc", "url", "status", "content_type", F.when(k == "html", decode(F.col("body"), charset(F.col("charset")))).alias("html"), F.octet_length("body").cast("long").alias("n_bytes"), k.alias("kind"), "error", "body", "attempts")
