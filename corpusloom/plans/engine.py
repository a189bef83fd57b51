"""A crawl as rounds of DataFrame plans: frontier, anti-join with what was visited, fetch, outcome, links, next frontier."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import CrawlConfig
from corpusloom.functions import urls
from corpusloom.functions.content import outcome
from corpusloom.operators.links import admitted, parsed_pages
from corpusloom.operators.sinks import crawl_stats, named, named_files, summary
from corpusloom.operators.text import first_of_each
from corpusloom.plans.state import CrawlState
from corpusloom.sources.seeds import ranked

log = logging.getLogger("corpusloom")
OUTCOMES = ("page", "file", "dup_file", "oversize", "denied", "failed")


@dataclass
class CrawlResult:
    """Tables of a crawl: visited (netloc, url, round, outcome, n_bytes, has_text), pages, texts and files with their contents and names, counters for each netloc, and the seconds it took."""

    visited: DataFrame
    pages: DataFrame
    texts: DataFrame
    files: DataFrame
    stats: DataFrame
    seconds: float = 0.0


class CrawlEngine:
    """Runs a crawl over any fetcher, round by round. A round's tables are committed together, so a crawl that stops goes on at the last committed round."""

    def __init__(self, spark: SparkSession, config: CrawlConfig, fetcher, state: CrawlState):
        self.spark, self.config, self.fetcher, self.state = spark, config, fetcher, state

    def admit(self, seeds: DataFrame) -> DataFrame:
        """(netloc, url) of seeds (url), normalised; seeds without a domain are rejected."""
        u = urls.normalize(F.col("url"), self.config.strip_tracking)
        return seeds.select(u.alias("url")).withColumn("netloc", urls.netloc(F.col("url"))).filter("netloc <> ''").select("netloc", "url").distinct()

    def run(self, seeds: DataFrame, fresh: bool = False, retry: bool = False) -> CrawlResult:
        """Crawl from ``seeds`` (url), or go on with the last committed round where the state has one and ``fresh`` isn't asked for.

        ``retry`` admits again the urls whose last outcome is failed.
        """
        began = time.monotonic()
        if fresh:
            self.state.clear()
        rounds = self.state.rounds()
        if rounds:
            frontier = self.state.read(rounds[-1], "frontier").unionByName(self.admit(seeds)).distinct()
            if retry:
                last = first_of_each(self.state.read_all("visited").withColumn("k", -F.col("round")), ["url"], ["k"])
                frontier = frontier.unionByName(last.filter("outcome = 'failed'").select("netloc", "url")).distinct()
        else:
            frontier = self.admit(seeds)
        n, start = (rounds[-1] + 1 if rounds else 0), (rounds[-1] if rounds else -1)
        while self.config.max_rounds is None or n - start <= self.config.max_rounds:
            visited = self.state.read_all("visited")
            todo = frontier
            if visited is not None:
                done = visited.filter("outcome <> 'failed'") if retry and n == start + 1 else visited
                todo = frontier.join(done.select("url").distinct(), "url", "left_anti")
            if todo.isEmpty():
                break
            frontier = self._round(n, todo)
            self._progress(n)
            n += 1
        return self.result(time.monotonic() - began)

    def _progress(self, n: int) -> None:
        """Log the counters so far; they are read from the stored counters of the rounds."""
        r = summary(self.state.stats()).first().asDict()
        log.info("Round %d: %s", n, " | ".join(f"{v} {k}" for k, v in r.items()))

    def _round(self, n: int, todo: DataFrame) -> DataFrame:
        c = self.config
        waiting = None
        if c.round_urls is not None:
            now = ranked(todo, ["netloc"], ["url"], c.round_urls).select("netloc", "url")
            waiting = todo.join(now.select("url"), "url", "left_anti").select("netloc", "url")
            todo = now
        got = self.fetcher.fetch(todo)
        got = got.withColumn("outcome", outcome(F.col("kind"), F.col("status"), F.col("html"), F.col("n_bytes"), F.col("error").isNotNull(), c.max_file_bytes))
        got = got.withColumn("hash", F.when(F.col("kind") == "file", F.md5(F.col("body") if "body" in got.columns else F.col("html").cast("binary")))).withColumn("round", F.lit(n))
        # written once, since everything below reads it
        got.write.mode("overwrite").parquet(f"{self.state.root}/round={n}/responses")
        got = self.spark.read.parquet(f"{self.state.root}/round={n}/responses")
        # of files with one content in a domain the first url counts, in this round or an earlier
        files = got.filter("outcome = 'file'")
        kept = first_of_each(files, ["netloc", "hash"], ["url"]).select("netloc", "url")
        old = self.state.read_all("files")
        if old is not None:
            kept = kept.join(files.select("netloc", "url", "hash").join(old.select("netloc", "hash").distinct(), ["netloc", "hash"], "left_semi").select("netloc", "url"), ["netloc", "url"], "left_anti")
        kept = kept.withColumn("__kept", F.lit(True))
        got = got.join(kept, ["netloc", "url"], "left").withColumn("outcome", F.when((F.col("outcome") == "file") & F.col("__kept").isNull(), "dup_file").otherwise(F.col("outcome"))).drop("__kept")
        # links and text come from one parse, written once since several tables need them
        parsed = parsed_pages(got.filter("outcome = 'page'").select("netloc", "url", "html", "n_bytes"))
        parsed.write.mode("overwrite").parquet(f"{self.state.root}/round={n}/parsed")
        parsed = self.spark.read.parquet(f"{self.state.root}/round={n}/parsed")
        links = parsed.select("url", F.inline("links")).withColumn("link", urls.normalize(F.col("abs_url"), c.strip_tracking))
        follow = links.filter(admitted(F.col("tag"), F.col("link"), urls.netloc(F.col("url")), c.excludes, c.strict_domain)).select(urls.netloc(F.col("url")).alias("netloc"), F.col("link").alias("url")).distinct()
        if waiting is not None:
            follow = follow.unionByName(waiting).distinct()
        texts = parsed.filter(F.rlike("text", F.lit(r"\S")))
        visited = got.select("netloc", "url", "round", "outcome", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))
        visited = visited.join(texts.select("url", F.lit(True).alias("__text")), "url", "left").select(*visited.columns, F.col("__text").isNotNull().alias("has_text"))
        content = F.col("body") if "body" in got.columns else F.col("html").cast("binary")
        tables = {
            "visited": visited, "files": got.filter("outcome = 'file'").select("netloc", "url", "round", "hash", "n_bytes", "content_type", content.alias("content")),
            "pages": parsed.select("netloc", "url", F.lit(n).alias("round"), "html", "n_bytes"), "texts": texts.select("netloc", "url", F.lit(n).alias("round"), "text"), "frontier": follow, "stats": crawl_stats(visited),
        }
        return self.state.commit(n, tables)["frontier"]

    def result(self, seconds: float = 0.0) -> CrawlResult:
        """The tables of all committed rounds; of a url that was tried again the last outcome holds. Names of an earlier round stay as they are."""
        visited = self.state.read_all("visited")
        if visited is None:
            of = lambda s: self.spark.createDataFrame([], s)
            visited = of("netloc string, url string, round int, outcome string, n_bytes long, has_text boolean")
            return CrawlResult(
                visited, of("netloc string, url string, round int, html string, n_bytes long, filename string"), of("netloc string, url string, round int, text string, filename string"),
                of("netloc string, url string, round int, hash string, n_bytes long, content_type string, content binary, filename string"), crawl_stats(visited), seconds,
            )
        last = visited.withColumn("__k", -F.col("round"))
        last = first_of_each(last, ["url"], ["__k"]).drop("__k")
        order = ["round", "url"]
        pages, texts = (named(self.state.read_all(t), F.col("url"), order, end) for t, end in (("pages", ".html"), ("texts", ".txt")))
        return CrawlResult(last, pages, texts, named_files(self.state.read_all("files"), order), crawl_stats(last), seconds)
