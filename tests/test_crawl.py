"""Names, content, links, seeds, sitemaps, state and the engine."""

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.config import CrawlConfig
from corpusloom.functions import content, names
from corpusloom.operators import links, sinks, text
from corpusloom.plans.closure import closure
from corpusloom.plans.engine import CrawlEngine
from corpusloom.plans.state import CrawlState
from corpusloom.sources import fetch, seeds, sitemap


def test_names(spark):
    cases = [("https://x/", "index"), ("https://x/en/12/", "en_12"), ("https://x/a/b.html", "a_b"), ("https://x/a/b.HTML", "a_b.HTML"), ("https://x/a%20b", "a_20b"), ("https://x/é", "é"), ("https://x/.html", "")]
    df = spark.createDataFrame(cases, "u string, w string")
    assert all(r["s"] == r["w"] for r in df.select("w", names.page_stem(F.col("u")).alias("s")).collect())
    files = spark.createDataFrame([("https://x/d/my%20r(1).pdf", None), ("https://x/d/", "application/pdf; x"), ("https://x/d/", "foo/bar")], "u string, c string")
    got = [r[0] for r in files.select(names.file_name(F.col("u"), F.col("c"))).collect()]
    assert got[0] == "my_20r_1_.pdf" and got[1].startswith("file_") and got[1].endswith(".pdf") and got[2].endswith(".bin")


def test_numbering_is_unique(spark):
    df = spark.createDataFrame([(1, "h", "a"), (2, "h", "a"), (3, "h", "a_1"), (4, "h", "a"), (5, "g", "a")], "i int, g string, s string")
    got = {r["i"]: r["n"] for r in names.numbered(df, ["g"], "s", ["i"], "n", ".txt").collect()}
    assert got[1] == "a.txt" and got[5] == "a.txt" and len({(("g" if i == 5 else "h"), n) for i, n in got.items()}) == 5


def test_made_names_never_meet_natural_ones(spark):
    stems = ["a", "a", "a_1", "a_1", "a_1_1", "a", "b", "a_1_1", "b_1"]
    df = spark.createDataFrame([(i, "h", s) for i, s in enumerate(stems)], "i int, g string, s string")
    got = [r["n"] for r in names.numbered(df, ["g"], "s", ["i"], "n").orderBy("i").collect()]
    assert len(set(got)) == len(stems) and got[0] == "a" and got[2] == "a_1" and got[1] == "a~1" and got[5] == "a_2"
    files = spark.createDataFrame([("h", f"https://h/{i}/r.pdf", None) for i in range(3)] + [("h", "https://h/.pdf", None), ("h", "https://h/r", "application/pdf")], "netloc string, url string, content_type string")
    assert sorted(r["filename"] for r in sinks.named_files(files, ["url"]).collect()) == [".pdf", "r", "r.pdf", "r_1.pdf", "r_2.pdf"]


def test_parse_page():
    html = "<nav><a href='/n'>menu</a></nav><main><h1>T</h1><p>a&amp;b <b>c</b><br>d<p>d<table><tr><td>x<td>y</table><script>no()</script></main><footer>f</footer>"
    found, text_ = links.parse_page(html, "https://x.com/")
    assert found == [("a", "https://x.com/n")] and text_ == "T\na&b c\nd\nx | y"
    assert links.parse_page("<p>one<p>two <nav>m", "u")[1] == "one\ntwo" and links.parse_page(None, "u") == ([], None) and links.parse_page("<article></article><p>z</p>", "u")[1] == "z"


def test_content(spark):
    rows = [("https://x/A.PDF", None, 200, "x"), ("https://x/a", "Application/PDF; charset=x", 200, "x"), ("https://x/a", "image/png", 200, "x"), ("https://x/a", "text/html", 403, "x"), ("https://x/a", "text/html", 200, "Access Denied" + "x" * 1986), ("https://x/a", "text/html", 200, "Access Denied" + "x" * 1987), ("https://x/a", "text/html", 404, "access denied"), ("https://x/a", None, None, None)]
    df = spark.createDataFrame(rows, "u string, c string, s int, h string")
    got = [tuple(r) for r in df.select(content.kind(F.col("u"), F.col("c")), content.denied(F.col("s"), F.col("h"))).collect()]
    assert got == [("file", False), ("file", False), ("html", False), ("html", True), ("html", True), ("html", False), ("html", False), ("html", False)]
    out = df.select(content.outcome(F.lit("file"), F.col("s"), F.col("h"), F.lit(11), F.lit(False), 10)).first()[0]
    assert out == "oversize"


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("é".encode()), "utf-8"), (bytearray("é".encode("utf-16")), "utf-16"), (bytearray(b"\xe9"), "nonsense"), (None, "utf-8")], "b binary, c string")
    assert [r[0] for r in df.select(content.decode("b", "c")).collect()] == ["é", "é", "�", None]


def test_links():
    html = '<a href="/a">x</a><a href="b"><a href="#f"><a href="https://y.com/z.pdf"><a href="mailto:a@b"><link href="//cdn.y.com/s.csv"><img src="/tag/x.pdf"><img src="/i.png"><iframe src="/f">'
    got = links.page_links(html, "https://x.com/d/p.html")
    assert ("a", "https://x.com/a") in got and ("a", "https://x.com/d/b") in got and ("link", "https://cdn.y.com/s.csv") in got and len(got) == 8
    assert links.page_links('<base href="/q/"><a href="r">', "https://x.com/") == [("a", "https://x.com/q/r")]
    assert links.page_links(None, "https://x.com/") == []


def test_admitted(spark):
    rows = [("a", "https://x.com/a", True), ("a", "https://y.com/a", False), ("a", "https://x.com/tag/x", False), ("a", "mailto:a", False), ("link", "https://y.com/s.csv", True), ("img", "https://x.com/tag/x.pdf", True), ("img", "https://x.com/i.png", False), ("a", None, False)]
    df = spark.createDataFrame(rows, "t string, l string, w boolean")
    assert all(r["w"] == r["g"] for r in df.select("w", links.admitted(F.col("t"), F.col("l"), F.lit("x.com")).alias("g")).collect())
    assert not df.filter("t = 'link'").select(links.admitted(F.col("t"), F.col("l"), F.lit("x.com"), strict=True)).first()[0]


def test_text(spark):
    html = "<body><nav>menu</nav><article><h1>T</h1><script>x</script><p>a&amp;b <b>c</b><br>d</p><!-- no --></article><footer>f</footer></body>"
    df = spark.createDataFrame([(html,), ("<p></p>",), (None,)], "h string")
    assert [r[0] for r in df.select(text.extract_text(F.col("h"))).collect()] == ["T\na&b c\nd", None, None]


def test_seeds(spark, tmp_path):
    p = tmp_path / "list"
    p.write_text(" https://a/ \n\n# x\nhttps://b/y\nhttps://a/2\n")
    got = seeds.collect(spark, "https://c/", str(p), str(p))
    assert [r["url"] for r in got.orderBy("origin", "ord").collect()] == ["https://c/", "https://a/", "https://b/y", "https://a/2", "https://a/", "https://b/y", "https://a/2"]
    by = {r["netloc"]: (r["start_url"], r["n_extra"]) for r in seeds.by_domain(seeds.read_list(spark, str(p))).collect()}
    assert by == {"a": ("https://a/", 1), "b": ("https://b/y", 0)}


def test_sitemap(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    xs = [f"<urlset {ns}><url><loc> https://x/1 </loc></url><url><loc>https://x/2</loc></url></urlset>", "<urlset><url><loc>https://x/2</loc></url></urlset>", f"<sitemapindex {ns}><sitemap><loc>https://x/c.xml</loc></sitemap></sitemapindex>", "<urlset><url>", None]
    df = spark.createDataFrame([("x", i, x) for i, x in enumerate(xs)], "h string, o int, x string")
    assert sorted(r["loc"] for r in sitemap.sitemap_urls(df, "h", "o", "x").collect()) == ["https://x/1", "https://x/2"]
    assert df.filter("o = 2").select(sitemap.locs(F.col("x"), "sitemap")).first()[0] == ["https://x/c.xml"]


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "z")], "src string, dst string")
    got = {r["url"]: r["depth"] for r in closure(e, spark.createDataFrame([("a",), (None,)], "url string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


@pytest.fixture
def corpus(spark):
    page = lambda i, u, h, s=200, c="text/html": (i, u, s, c, h)
    rows = [
        page(1, "https://x.com/", '<a href="/a/?utm_source=q">a</a><a href="/f.pdf">f</a><a href="/g.pdf">g</a><a href="https://y.com/">y</a><a href="/gone">g</a><a href="/no">n</a>'), page(2, "https://x.com/a/", '<a href="/b#t">b</a>'),
        page(3, "https://x.com/b", '<a href="/">home</a>'), page(4, "https://x.com/f.pdf", "same"), page(5, "https://x.com/g.pdf", "same"), page(6, "https://x.com/no", "Access Denied"), page(7, "https://y.com/", "y"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, http_status int, content_type string, content string")


def outcomes(result):
    return {r["url"]: r["outcome"] for r in result.visited.collect()}


WANT = {"https://x.com/": "page", "https://x.com/a/": "page", "https://x.com/b": "page", "https://x.com/f.pdf": "file", "https://x.com/g.pdf": "dup_file", "https://x.com/gone": "failed", "https://x.com/no": "denied"}


def test_engine_resume_and_retry(spark, corpus, tmp_path):
    start = spark.createDataFrame([("https://x.com/",), ("nonsense",)], "url string")
    # the strip of tracking leaves the slash of /a/?utm_source=q, and the plain form of the stored /a/ is /a
    pages = corpus.unionByName(corpus.filter("page_id = 2").withColumn("url", F.lit("https://x.com/a/?utm_source=q")).withColumn("page_id", F.lit(8).cast("long")))
    whole = CrawlEngine(spark, CrawlConfig(), fetch.CorpusFetcher(pages), CrawlState(spark, str(tmp_path / "a"))).run(start)
    assert outcomes(whole) == WANT
    stats = whole.stats.first().asDict()
    assert (stats["pages_downloaded"], stats["files_downloaded"], stats["errors"], stats["denied"]) == (3, 1, 1, 1)
    assert stats["text_extracted"] == 3 and {r["filename"]: r["text"].split("\n")[0] for r in whole.texts.collect()}.keys() == {"index.txt", "a.txt", "b.txt"}
    assert [(r["filename"], bytes(r["content"])) for r in whole.files.collect()] == [("f.pdf", b"same")] and {r["filename"] for r in whole.pages.collect()} == {"index.html", "a.html", "b.html"}
    stored = CrawlState(spark, str(tmp_path / "a"))
    assert stored.stats().first()["pages_downloaded"] == 3 and stored.known_hashes().count() == 1
    # one url of a domain in a round gives the same in more rounds
    slow = CrawlEngine(spark, CrawlConfig(round_urls=1), fetch.CorpusFetcher(pages), CrawlState(spark, str(tmp_path / "s"))).run(start)
    assert outcomes(slow) == WANT
    # stopped after one round, then resumed
    state = CrawlState(spark, str(tmp_path / "b"))
    CrawlEngine(spark, CrawlConfig(max_rounds=1), fetch.CorpusFetcher(pages), state).run(start)
    assert state.rounds() == [0]
    (tmp_path / "b" / "round=1").mkdir()  # a round that was never committed
    again = CrawlEngine(spark, CrawlConfig(), fetch.CorpusFetcher(pages), state).run(start)
    assert outcomes(again) == WANT
    # failed urls are tried again when asked for
    more = pages.unionByName(pages.filter("page_id = 3").withColumn("url", F.lit("https://x.com/gone")).withColumn("page_id", F.lit(9).cast("long")))
    assert outcomes(CrawlEngine(spark, CrawlConfig(), fetch.CorpusFetcher(more), state).run(start)) == WANT
    assert outcomes(CrawlEngine(spark, CrawlConfig(), fetch.CorpusFetcher(more), state).run(start, retry=True)) == WANT | {"https://x.com/gone": "page"}
    state.clear()
    assert state.rounds() == []


def test_http_retry():
    calls = []

    class Opener:
        def open(self, request, timeout):
            calls.append(request.full_url)
            raise TimeoutError("slow")

    status, *_, n, error = fetch.get("http://h/", CrawlConfig(max_retries=1), Opener())
    assert status is None and n == 1 and "slow" in error and len(calls) == 1


def test_sinks(spark, tmp_path):
    assert not sinks.write_list(spark.createDataFrame([], "url string"), str(tmp_path / "l"))
    assert sinks.write_list(spark.createDataFrame([("b",), ("a",)], "url string"), str(tmp_path / "l"))


def test_cli(spark, corpus, tmp_path):
    assert cli.main([]) == 1
    a = cli.parse_args(["https://x.com/", "--no-default-excludes", "--exclude-pattern", "/a", "--no-use-sitemap"])
    c = cli.config_of(a)
    assert c.excludes == ("/a",) and not c.use_sitemap and c.strip_tracking
    corpus.write.parquet(str(tmp_path / "c"))
    assert cli.main(["https://x.com/", "--corpus", str(tmp_path / "c"), "--out", str(tmp_path / "o"), "--max-rounds", "2"]) == 0
    assert {p.name for p in (tmp_path / "o").iterdir()} >= {"pages", "text", "files", "logs", "state"}
    said = (tmp_path / "o" / "logs" / "crawl.log").read_text()
    assert "Round 0" in said and "Duration" in said and "Texts: " in said
    assert cli.main(["https://x.com/", "--corpus", str(tmp_path / "c"), "--out", str(tmp_path / "t"), "--layout", "files"]) == 0
    assert (tmp_path / "t" / "x.com" / "files" / "f.pdf").read_text() == "same" and (tmp_path / "t" / "x.com" / "text" / "index.txt").exists() and (tmp_path / "t" / "x.com" / "pages" / "index.html").exists()
