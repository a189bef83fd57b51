"""The command line: crawl urls and write the corpus."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from corpusloom.config import CrawlConfig, exclude_patterns

log = logging.getLogger("corpusloom")


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="corpusloom", description="Crawl sites round by round and write pages, files, state and counters.")
    p.add_argument("url", nargs="?")
    p.add_argument("--file", "-f")
    p.add_argument("--retry", "-r")
    p.add_argument("--concurrency", type=int, default=CrawlConfig.max_concurrent)
    p.add_argument("--timeout", type=float, default=CrawlConfig.timeout)
    p.add_argument("--delay", type=float, default=CrawlConfig.delay)
    p.add_argument("--fresh", action="store_true")
    p.add_argument("--exclude-pattern", action="append", default=None)
    p.add_argument("--no-default-excludes", action="store_true")
    for name in ("strip-tracking-params", "use-sitemap"):
        g = p.add_mutually_exclusive_group()
        g.add_argument(f"--{name}", dest=name.replace("-", "_"), action="store_true", default=True)
        g.add_argument(f"--no-{name}", dest=name.replace("-", "_"), action="store_false")
    p.add_argument("--max-rounds", type=int, default=None)
    p.add_argument("--round-urls", type=int, default=None, help="urls of a domain in one round")
    p.add_argument("--layout", choices=("tables", "files"), default="tables", help="write Parquet tables, or a file for each page, text and document below OUT/domain, which all executors must have mounted")
    p.add_argument("--corpus", help="answer from this Parquet table of pages instead of the network")
    p.add_argument("--out", default="data")
    return p.parse_args(argv)


def config_of(a: argparse.Namespace) -> CrawlConfig:
    return CrawlConfig(max_concurrent=a.concurrency, timeout=a.timeout, delay=a.delay, strip_tracking=a.strip_tracking_params, use_sitemap=a.use_sitemap, excludes=exclude_patterns(a.exclude_pattern, not a.no_default_excludes), max_rounds=a.max_rounds, round_urls=a.round_urls, per_host=a.concurrency)


def start_log(out: str) -> None:
    """Log to the terminal, and with details to ``out/logs/crawl.log`` where that is a folder of this machine."""
    log.setLevel(logging.DEBUG)
    log.propagate = False
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    shown = logging.StreamHandler()
    shown.setLevel(logging.INFO)
    handlers = [(shown, "%(message)s")]
    if "://" not in out:
        os.makedirs(f"{out}/logs", exist_ok=True)
        handlers.append((logging.FileHandler(f"{out}/logs/crawl.log"), "%(asctime)s %(levelname)s %(message)s"))
    for h, form in handlers:
        h.setFormatter(logging.Formatter(form))
        log.addHandler(h)


def sitemap_seeds(spark, seeds, config: CrawlConfig, fetcher):
    """Seeds (url) from the sitemaps of the seeds' domains, and of their children."""
    from pyspark.sql import functions as F

    from corpusloom.functions import urls
    from corpusloom.sources import sitemap

    hosts = seeds.select(urls.scheme(F.col("url")).alias("s"), urls.netloc(F.col("url")).alias("netloc")).filter("netloc <> ''").distinct()
    at = hosts.select("netloc", F.explode(F.array(F.concat("s", F.lit("://"), "netloc", F.lit("/sitemap.xml")), F.concat("s", F.lit("://"), "netloc", F.lit("/sitemap_index.xml")))).alias("url"))
    maps = fetcher.fetch(at)
    children = maps.select("netloc", F.explode(sitemap.locs(F.col("html"), "sitemap")).alias("url")).distinct()
    every = maps.select("netloc", "url", "html").unionByName(fetcher.fetch(children).select("netloc", "url", "html"))
    found = sitemap.sitemap_urls(every, "netloc", "url", "html")
    return sitemap.admitted_urls(found, "netloc", config.max_sitemap_urls, excludes=config.excludes, tracking=config.strip_tracking).select(F.col("url_norm").alias("url"))


def main(argv: list[str] | None = None) -> int:
    a = parse_args(argv)
    if not (a.url or a.file or a.retry):
        print("no urls given", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from corpusloom.operators.sinks import report, report_lines, write_corpus, write_list, write_tree
    from corpusloom.plans.engine import CrawlEngine
    from corpusloom.plans.state import CrawlState
    from corpusloom.sources.fetch import CorpusFetcher, HttpFetcher
    from corpusloom.sources.seeds import collect

    spark = SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = config_of(a)
    start_log(a.out)
    seeds = collect(spark, a.url, a.file, a.retry)
    if seeds.isEmpty():
        print("no urls given", file=sys.stderr)
        return 1
    fetcher = CorpusFetcher(spark.read.parquet(a.corpus), config.strip_tracking) if a.corpus else HttpFetcher(config)
    start = seeds.select("url")
    if config.use_sitemap:
        start = start.unionByName(sitemap_seeds(spark, seeds, config, fetcher))
    result = CrawlEngine(spark, config, fetcher, CrawlState(spark, f"{a.out}/state")).run(start, fresh=a.fresh, retry=bool(a.retry))
    for kind, rows, content in (("pages", result.pages, "html"), ("text", result.texts, "text"), ("files", result.files, "content")):
        if a.layout == "files":
            write_tree(rows, os.path.abspath(a.out), kind, content)
        else:
            write_corpus(rows, f"{a.out}/{kind}")
    write_list(result.visited.filter("outcome = 'denied'"), f"{a.out}/logs/access_denied")
    failed = write_list(result.visited.filter("outcome = 'failed'"), f"{a.out}/logs/failed_urls")
    for line in report_lines(report(result.stats, result.visited.count(), result.seconds, a.out)):
        log.info(line)
    if failed:
        log.info("failed urls are in %s/logs/failed_urls; give them to --retry", a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
