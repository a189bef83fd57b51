"""The queries of the core: over whole tables with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import oracle
from corpusloom.config import CrawlConfig, exclude_patterns
from corpusloom.functions import content, names, urls
from corpusloom.operators import compaction, links, sinks, text
from corpusloom.plans import closure
from corpusloom.plans.engine import CrawlEngine
from corpusloom.plans.state import CrawlState
from corpusloom.plans.storage import shared_dir
from corpusloom.sources import fetch, seeds, sitemap
from corpusloom.sources.tables import table
from corpusloom.streaming import streams


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """The stored files, the records that they hold, and their bytes."""
    files = table(spark, d, "stored_files").select("file_id", "file_kind", "record_id", "n_bytes").distinct()
    pages = table(spark, d, "pages").select(F.lit("page").alias("file_kind"), F.col("page_id").alias("record_id"), "url", F.col("content").alias("body"))
    texts = table(spark, d, "text_out").select(F.lit("text").alias("file_kind"), F.col("text_id").alias("record_id"), "url", F.col("extracted_text").alias("body"))
    return files, pages.unionByName(texts), int(files.agg(F.sum("n_bytes")).first()[0] or 0)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    files, members, n = _members(spark, d)
    manifest, _ = compaction.compact(members, "body", total_bytes=n)
    return compaction.same_records(files, manifest, ["file_kind", "record_id"])


def p5_manifest(spark: SparkSession, d: str) -> DataFrame:
    _, members, n = _members(spark, d)
    return compaction.compact(members, "body", total_bytes=n)[0].select("file_kind", "record_id", F.col("length").alias("n_bytes"), "sha256")


def p5_verify(spark: SparkSession, d: str) -> DataFrame:
    _, members, n = _members(spark, d)
    return compaction.verify(*compaction.compact(members, "body", total_bytes=n))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _u(name: str = "url", tracking: bool = True):
    return urls.normalize(F.col(name), tracking)


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("url")
    return _pages(spark, d).select("page_id", urls.scheme(c).alias("scheme"), urls.netloc(c).alias("netloc"), urls.path(c).alias("path"), urls.params(c).alias("params"), urls.query(c).alias("query"), urls.fragment(c).alias("fragment"))


def url_domain(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.netloc(F.col("url")).alias("netloc"))


def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", _u(tracking=False).alias("url_norm"))


def strip_tracking(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visited").groupBy("url").agg(F.count("*").alias("n")).select("url", _u().alias("url_norm"), "n")


def url_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).groupBy(_u().alias("url_norm")).agg(F.min("page_id").alias("page_id"))


def exclude_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visited").select("url").distinct().select("url", urls.excluded(F.col("url")).alias("excluded"))


def exclude_custom(spark: SparkSession, d: str) -> DataFrame:
    own = exclude_patterns([r"[?]page=", r"\.zip$"], defaults=False)
    return table(spark, d, "visited").select("url").distinct().select("url", urls.excluded(F.col("url"), own).alias("excluded"))


def download_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visited").select("url").distinct().select("url", urls.downloadable(F.col("url")).alias("is_download"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("url", "content_type").union(table(spark, d, "visited").select("url", F.lit(None).cast("string"))).distinct()


def classify_kind(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("url", content.kind(F.col("url"), F.col("content_type")).alias("kind"))


def charset_choice(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", content.charset(F.col("declared_charset")).alias("encoding"))


def denied_detect(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", content.denied(F.col("http_status"), F.col("content")).alias("denied"))


def oversize_filter(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).filter("content is not null").select("page_id", (F.octet_length("content") > 4000).alias("oversize"))


def page_stem(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", names.page_stem(F.col("url")).alias("stem"))


def file_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visited").select("url").distinct().select("url", names.file_name(F.col("url"), F.lit(None).cast("string")).alias("filename"))


def file_ext(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("url", names.file_extension(F.col("url"), F.col("content_type")).alias("ext"))


def collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    return page_sink(spark, d).drop("n_bytes")


def file_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))
    return docs.groupBy("md5").agg(F.min("doc_id").alias("doc_id"))


def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.explode(links.hrefs(F.col("html_content"))).alias("href"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, netloc, norm_url): the anchors of all pages."""
    h = _pages(spark, d).select("page_id", "url", F.explode(links.hrefs(F.col("html_content"))).alias("href"))
    a = h.select("page_id", urls.netloc(F.col("url")).alias("netloc"), urls.resolve(F.col("url"), F.col("href")).alias("a"))
    return a.select("page_id", "netloc", _u("a").alias("norm_url")).distinct()


def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("page_id", "norm_url")


def same_domain_links(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).filter(links.admitted(F.lit("a"), F.col("norm_url"), F.col("netloc"))).select("page_id", "norm_url")


def asset_links(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "visited").select("url", F.col("base_domain").alias("netloc")).distinct()
    return v.filter(links.admitted(F.lit("link"), F.col("url"), F.col("netloc")))


def parsed_links(spark: SparkSession, d: str) -> DataFrame:
    return links.parsed_links(_pages(spark, d)).select(F.col("id").alias("page_id"), "tag", "abs_url")


def extract_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", text.extract_text(F.col("html_content")).alias("text"))


def text_dedup(spark: SparkSession, d: str) -> DataFrame:
    return text.distinct_lines(table(spark, d, "documents"), "doc_id", "text")


def seed_collect(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    listed = p.select(F.col("page_id").alias("ord"), F.concat(F.lit("  "), "url", F.lit(" \t")).alias("line"))
    noise = p.select(F.col("page_id").alias("ord"), F.concat(F.lit("# "), "url").alias("line")).unionByName(p.select(F.col("page_id").alias("ord"), F.lit("   ").alias("line")))
    retry = p.filter("html_content is null").select(F.col("page_id").alias("ord"), F.col("url").alias("line"))
    return seeds.parse_lines(listed.unionByName(noise).unionByName(retry))


def seeds_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return seeds.by_domain(_pages(spark, d).select(F.col("page_id").alias("ord"), "url"))


def _maps(spark: SparkSession, d: str) -> DataFrame:
    """One sitemap for each page, of each site, in several dialects of XML."""
    p = _pages(spark, d).select(urls.netloc(F.col("url")).alias("host"), "page_id", "url")
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("<url><loc> "), escaped, F.lit("</loc></url>"))
    prefixed = F.concat(F.lit('<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>'), escaped, F.lit("</s:loc></s:url></s:urlset>"))
    spaced = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entry, F.lit("</urlset>"))
    return p.withColumn("xml", F.when(F.length("url") % 2 == 0, spaced).otherwise(prefixed))


def sitemap_locs(spark: SparkSession, d: str) -> DataFrame:
    m = _maps(spark, d)
    broken = m.withColumn("xml", F.when(F.startswith("url", F.lit("https")), F.col("xml")).otherwise(F.substring("xml", 1, 20)))
    return sitemap.sitemap_urls(broken, "host", "page_id", "xml").select("host", "loc")


def sitemap_seed(spark: SparkSession, d: str) -> DataFrame:
    return sitemap.admitted_urls(sitemap.sitemap_urls(_maps(spark, d), "host", "page_id", "xml"), "host", 20)


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("netloc", F.col("norm_url").alias("url")).distinct()


def frontier_antijoin(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "visited").select("url").distinct().select(_u().alias("url")).distinct()
    return _frontier(spark, d).join(seen, "url", "left_anti").select("netloc", "url")


def frontier_batch(spark: SparkSession, d: str) -> DataFrame:
    return seeds.ranked(_frontier(spark, d), ["netloc"], ["url"], 100).select("netloc", "url")


def fetch_corpus(spark: SparkSession, d: str) -> DataFrame:
    fetcher = fetch.CorpusFetcher(_pages(spark, d))
    todo = _frontier(spark, d).select("url").union(fetcher.pages.select("url")).distinct().withColumn("netloc", urls.netloc(F.col("url")))
    return fetcher.fetch(todo).select("url", F.col("error").isNull().alias("found"))


def url_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("page_id", "url", "outcome")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).withColumn("n_bytes", F.octet_length("content").cast("long")).withColumn("kind", content.kind(F.col("url"), F.col("content_type")))
    lost = F.col("content").isNull() & F.col("http_status").isNull()
    texts = table(spark, d, "text_out").filter(F.rlike("extracted_text", F.lit(r"\S"))).select("page_id", F.lit(True).alias("__text")).distinct()
    p = p.join(texts, "page_id", "left").withColumn("has_text", F.col("__text").isNotNull())
    return p.withColumn("outcome", content.outcome(F.col("kind"), F.col("http_status"), F.col("content"), F.col("n_bytes"), lost, 5000)).withColumn("netloc", urls.netloc(F.col("url")))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """A graph of urls: customers to orders to parts to suppliers, and back."""
    edge = lambda t, a, x, b, y: t.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    first = table(spark, d, "lineitem").filter("l_linenumber = 1")
    out = edge(table(spark, d, "orders"), "/c/", "o_custkey", "/o/", "o_orderkey").unionByName(edge(first, "/o/", "l_orderkey", "/p/", "l_partkey"))
    return out.unionByName(edge(first, "/p/", "l_partkey", "/s/", "l_suppkey")).unionByName(edge(table(spark, d, "supplier"), "/s/", "s_suppkey", "/c/", "s_suppkey")).distinct()


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("/c/1",)], "url string")


def crawl_closure(spark: SparkSession, d: str) -> DataFrame:
    return closure.closure(_edges(spark, d), _start(spark)).select("url")


def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    return closure.closure(_edges(spark, d), _start(spark))


def resume_frontier(spark: SparkSession, d: str) -> DataFrame:
    return closure.closure(_edges(spark, d), _start(spark), max_rounds=3).filter("depth = 3").select("url")


def multi_domain_crawl(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).select("page_id", _u().alias("url"))
    start = p.withColumn("netloc", urls.netloc(F.col("url"))).groupBy("netloc").agg(F.min_by("url", "page_id").alias("url")).select("url")
    fetcher = fetch.CorpusFetcher(_pages(spark, d))
    state = CrawlState(spark, f"{shared_dir(spark)}/corpusloom/crawl-{uuid.uuid4().hex}")
    result = CrawlEngine(spark, CrawlConfig(), fetcher, state).run(start)
    return result.visited.groupBy("netloc").agg(F.countDistinct("url").alias("visited"))


def crawl_stats(spark: SparkSession, d: str) -> DataFrame:
    return sinks.crawl_stats(_outcomes(spark, d))


def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    return sinks.summary(crawl_stats(spark, d))


def stats_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    s = crawl_stats(spark, d)
    return s.select("netloc", F.from_json(F.to_json(F.struct(*s.columns[1:])), s.drop("netloc").schema).alias("j")).select("netloc", "j.*")


def visited_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visited").select(F.col("base_domain").alias("netloc"), "url").distinct().groupBy("netloc").agg(F.count("*").alias("visited"))


def denied_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visited").filter("outcome = 'denied'").select("url").distinct()


def failed_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visited").filter("outcome = 'failed'").select("url").distinct()


def retry_outcome(spark: SparkSession, d: str) -> DataFrame:
    tries = F.coalesce("attempts", F.lit(0))
    v = table(spark, d, "visited").groupBy("url").agg(F.max(F.least(tries, F.lit(3))).cast("int").alias("attempts"), F.max(tries).alias("most"), F.count_if(~F.col("outcome").eqNullSafe("failed")).alias("other"))
    return v.select("url", "attempts", F.when((F.col("most") >= 3) & (F.col("other") == 0), "failed").otherwise("done").alias("outcome"))


def page_sink(spark: SparkSession, d: str) -> DataFrame:
    return sinks.page_files(_pages(spark, d), "page_id", "url", "content")


def text_sink(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "text_out").filter(F.rlike("extracted_text", F.lit(r"\S")))
    return sinks.page_files(t, "text_id", "url", "extracted_text", ".txt").drop("n_bytes")


def page_names_distinct(spark: SparkSession, d: str) -> DataFrame:
    """An invariant of ``page_sink``: no two pages of a domain have one name."""
    return page_sink(spark, d).groupBy("netloc").agg(F.count("*").alias("n_pages"), F.countDistinct("filename").alias("n_names"))


def file_sink(spark: SparkSession, d: str) -> DataFrame:
    """Names of the documents that a crawl would store, a number before the extension where urls share one."""
    v = table(spark, d, "visited").select(F.col("base_domain").alias("netloc"), "url", F.lit(None).cast("string").alias("content_type")).distinct().filter(urls.downloadable(F.col("url")))
    return sinks.named_files(v, ["url"]).select("netloc", "url", "filename")


def page_parse(spark: SparkSession, d: str) -> DataFrame:
    """Links and text of every page by one parse."""
    p = links.parsed_pages(_pages(spark, d).select("page_id", "url", F.col("html_content").alias("html")))
    return p.select("page_id", F.size("links").alias("n_links"), F.coalesce(F.length("text"), F.lit(0)).alias("text_chars"))


def progress_window(spark: SparkSession, d: str) -> DataFrame:
    return streams.progress_windows(table(spark, d, "events"), "ts", F.col("event_type") == "error")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_url, url_parts, url_domain, strip_tracking, url_distinct, exclude_filter, exclude_custom, download_filter, classify_kind, charset_choice, denied_detect, oversize_filter, page_stem, file_name, file_ext, collision_suffix,
        file_dedup, extract_links, resolve_links, same_domain_links, asset_links, parsed_links, extract_text, text_dedup, seed_collect, seeds_by_domain, sitemap_locs, sitemap_seed, frontier_antijoin, frontier_batch, fetch_corpus, url_outcome,
        crawl_closure, bfs_depth, resume_frontier, multi_domain_crawl, crawl_stats, crawl_summary, stats_roundtrip, visited_count, denied_urls, failed_urls, retry_outcome, page_sink, page_names_distinct, text_sink, file_sink, page_parse, progress_window, p5_found, p5_manifest, p5_verify,
    )
}

_RECORDS = """SELECT 'page' AS file_kind, page_id AS record_id, url, content AS body FROM pages
UNION ALL SELECT 'text', text_id, url, extracted_text FROM text_out"""

SQL = {
    **oracle.SQL,
    "p5_found": f"""WITH r AS ({_RECORDS}), f AS (SELECT DISTINCT s.file_id, s.file_kind, r.url, r.body FROM stored_files s JOIN r ON s.file_kind = r.file_kind AND s.record_id = r.record_id)
SELECT DISTINCT a.file_id AS file_a, b.file_id AS file_b FROM f a JOIN f b ON a.file_kind = b.file_kind AND a.url = b.url AND a.body = b.body AND a.file_id < b.file_id""",
    "p5_manifest": f"SELECT file_kind, record_id, CAST(strlen(body) AS BIGINT) AS n_bytes, sha256(body) AS sha256 FROM ({_RECORDS}) WHERE body IS NOT NULL",
}
