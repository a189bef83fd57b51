"""URLs: hand-traced cases, and the column expressions against the standard library."""

from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlsplit, urlunsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.config import TRACKING, exclude_patterns
from corpusloom.functions import urls

CASES = [
    ("https://x.com/a/", "https://x.com/a", None), ("https://x.com/", "https://x.com/", None), ("https://x.com", "https://x.com", None), ("https://x.com//a//", "https://x.com//a/", None),
    ("https://x.com/a#f", "https://x.com/a", None), ("https://x.com/a;q?x=1", "https://x.com/a?x=1", None), ("https://x.com/a?", "https://x.com/a", None), ("https://x.com/a?utm_source=e", "https://x.com/a?utm_source=e", "https://x.com/a"),
    ("https://x.com/a/?utm_source=e", "https://x.com/a/?utm_source=e", "https://x.com/a/"), ("https://x.com/a?utm%5Fsource=e&b=1", "https://x.com/a?utm%5Fsource=e&b=1", "https://x.com/a?b=1"),
    ("https://x.com/a?UTM_SOURCE=e", "https://x.com/a?UTM_SOURCE=e", None), ("https://x.com/a?b&c=", "https://x.com/a?b&c=", "https://x.com/a?b=&c="), ("https://x.com/a?f=%20x+y", "https://x.com/a?f=%20x+y", "https://x.com/a?f=+x+y"),
    ("https://x.com/a?d=1;e=2", "https://x.com/a?d=1;e=2", "https://x.com/a?d=1%3Be%3D2"), ("https://x.com/a?a=1&&a=2", "https://x.com/a?a=1&&a=2", "https://x.com/a?a=1&a=2"), ("https://x.com/p?next=/", "https://x.com/p?next=", None),
    ("https://x.com/?a=/", "https://x.com/?a=/", "https://x.com/?a=%2F"), ("HTTPS://X.com/A", "https://X.com/A", None), (None, None, None),
]


def one(spark, urls_, **exprs):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls_)], "i int, u string")
    return [r.asDict() for r in df.select("i", *[f(F.col("u")).alias(n) for n, f in exprs.items()]).orderBy("i").collect()]


def test_normalize_cases(spark):
    got = one(spark, [c[0] for c in CASES], off=urls.normalize, on=lambda c: urls.normalize(c, True))
    for (url, off, on), r in zip(CASES, got):
        assert r["off"] == off, url
        # where only the strip leaves it as it was
        want = on if on is not None else ("https://x.com/p?next=" if url and url.endswith("next=/") else off)
        assert r["on"] == want, url


_part = st.text(st.sampled_from("abcXY012-._~/%é"), max_size=8)
_query = st.lists(st.tuples(st.sampled_from(["utm_source", "ref", "a", "b", "gclid"]), st.text(st.sampled_from("abc /+&=é%*~"), max_size=5)), max_size=3)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(_part, _query), min_size=20, max_size=40))
def test_against_the_standard_library(spark, parts):
    us = [f"https://h.example/{p.replace('%', '')}" + ("?" + urlencode(q) if q else "") for p, q in parts]

    def normal(u):
        p = urlparse(u)
        out = f"{p.scheme}://{p.netloc}{p.path}" + (f"?{p.query}" if p.query else "")
        return out[:-1] if out.endswith("/") and p.path != "/" else out

    def strip(u):
        p = urlsplit(u)
        return urlunsplit((p.scheme, p.netloc, p.path, urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k not in TRACKING]), "")) if p.query else u

    got = one(spark, us, off=urls.normalize, on=lambda c: urls.normalize(c, True), host=urls.netloc)
    for u, r in zip(us, got):
        assert r["off"] == normal(u)
        assert r["on"] == strip(normal(u))
        assert "#" not in r["on"] and r["host"] == "h.example"


@pytest.mark.parametrize("href", ["/a", "b", "../c", "./d", "../../../e", "?q=1", "#f", "//cdn.y.com/s.csv", "https://y.com/z", "mailto:a@b", "", "a/../b/./c", "x/..", "g;x=1"])
def test_resolve(spark, href):
    base = "https://x.com/d/e/p.html?k=v"
    df = spark.createDataFrame([(base, href)], "b string, h string").select(urls.resolve(F.col("b"), F.col("h")).alias("r"))
    assert df.first()["r"] == urljoin(base, href)


def test_filters(spark):
    us = ["https://x.com/tag/a", "https://x.com/feed", "https://x.com/feed/x", "https://x.com/A.PDF", "https://x.com/a?f=x.pdf", "https://x.com/page/12", "https://x.com/a?print=1"]
    got = one(spark, us, ex=urls.excluded, no=lambda c: urls.excluded(c, ()), own=lambda c: urls.excluded(c, exclude_patterns(["A[.]"], False)), dl=urls.downloadable)
    assert [r["ex"] for r in got] == [True, True, False, False, False, True, True]
    assert not any(r["no"] for r in got)
    assert [r["own"] for r in got] == [False, False, False, True, False, False, False]
    assert [r["dl"] for r in got] == [False, False, False, True, False, False, False]
