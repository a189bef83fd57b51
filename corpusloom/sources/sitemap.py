"""Sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import EXCLUDES
from corpusloom.functions import urls

SCHEMA = "url ARRAY<STRUCT<loc: STRING>>, sitemap ARRAY<STRUCT<loc: STRING>>"
_OPTIONS = {"rowTag": "urlset", "ignoreNamespace": "true", "mode": "PERMISSIVE"}


def locs(xml: Column, of: str = "url") -> Column:
    """The locations of a sitemap's pages (``of`` url) or child sitemaps (sitemap); empty where the XML is broken or missing."""
    parsed = F.from_xml(xml, SCHEMA, _OPTIONS)
    found = F.transform(F.coalesce(parsed[of], F.array().cast("array<struct<loc:string>>")), lambda x: F.trim(x["loc"]))
    return F.filter(found, lambda x: x.isNotNull() & (x != ""))


def sitemap_urls(maps: DataFrame, host: str, ord_col: str, xml: str) -> DataFrame:
    """(host, ord, loc) of the pages of all sitemaps, each url where it stands first."""
    rows = maps.select(host, F.col(ord_col).alias("__o"), F.posexplode(locs(F.col(xml))).alias("__p", "loc"))
    return rows.groupBy(host, "loc").agg(F.min(F.struct("__o", "__p")).alias("ord")).select(host, "ord", "loc")


def admitted_urls(found: DataFrame, host: str, limit: int, visited: DataFrame | None = None, excludes: tuple[str, ...] = EXCLUDES, tracking: bool = True) -> DataFrame:
    """(host, url_norm, rnk): the first ``limit`` locations of a host, normalised, of its own domain, not excluded, not visited."""
    from corpusloom.sources.seeds import ranked

    top = ranked(found, [host], ["ord"], limit)
    out = top.withColumn("url_norm", urls.normalize(F.col("loc"), tracking)).filter((urls.netloc(F.col("url_norm")) == F.col(host)) & ~urls.excluded(F.col("url_norm"), excludes))
    out = out.groupBy(host, "url_norm").agg(F.min("rnk").alias("rnk"))
    return out.join(visited.select(F.col("url").alias("url_norm")), "url_norm", "left_anti").select(host, "url_norm", "rnk") if visited is not None else out
