"""What a crawl writes: pages, texts, files, lists and counters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.names import file_name, numbered, page_stem
from corpusloom.functions.urls import netloc


def page_files(pages: DataFrame, id_col: str, url_col: str, body: str, extension: str = ".html") -> DataFrame:
    """(netloc, id, filename, n_bytes): a name for each page that no other of its domain has, and the bytes of its content."""
    p = pages.select(netloc(F.col(url_col)).alias("netloc"), F.col(id_col), page_stem(F.col(url_col)).alias("stem"), F.octet_length(body).cast("long").alias("n_bytes"))
    return numbered(p, ["netloc"], "stem", [id_col], "filename", extension).select("netloc", id_col, "filename", "n_bytes")


COUNTERS = ("pages_downloaded", "files_downloaded", "text_extracted", "errors", "denied", "total_bytes")


def crawl_stats(visited: DataFrame) -> DataFrame:
    """(netloc and the ``COUNTERS``) from outcomes; ``has_text`` tells pages with text of their own; bytes of pages and files only."""
    kept = F.col("outcome").isin("page", "file")
    n = lambda o: F.count_if(F.col("outcome") == o)
    return visited.groupBy("netloc").agg(
        n("page").alias("pages_downloaded"), n("file").alias("files_downloaded"), F.count_if((F.col("outcome") == "page") & F.col("has_text")).alias("text_extracted"),
        n("failed").alias("errors"), n("denied").alias("denied"), F.coalesce(F.sum(F.when(kept, F.col("n_bytes"))), F.lit(0)).alias("total_bytes"),
    )


def summary(stats: DataFrame) -> DataFrame:
    """One row of totals, with bytes as MiB too."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    return stats.agg(*sums).withColumn("total_mib", F.round(F.col("total_bytes") / (1024 * 1024), 2))


def report(stats: DataFrame, visited: int, seconds: float, location: str) -> dict:
    """The final report of a crawl."""
    return {"duration_s": round(seconds, 2), "visited": visited, **summary(stats).first().asDict(), "location": location}


def report_lines(r: dict) -> list[str]:
    """A final report as lines of a log."""
    names = (("Duration", "duration_s"), ("Visited", "visited"), ("Pages", "pages_downloaded"), ("Texts", "text_extracted"), ("Files", "files_downloaded"), ("Denied", "denied"), ("Errors", "errors"), ("MiB", "total_mib"), ("Written to", "location"))
    return [f"{name}: {r[key]}" for name, key in names]


def named(rows: DataFrame, url: Column, order: list[str], extension: str) -> DataFrame:
    """``rows`` of pages or texts (netloc) with a ``filename`` that no other of their domain has."""
    return numbered(rows.withColumn("__stem", page_stem(url)), ["netloc"], "__stem", order, "filename", extension).drop("__stem")


def named_files(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` of files (netloc, url, content_type) with a ``filename`` that no other of their domain has: a number stands before the extension."""
    whole = file_name(F.col("url"), F.col("content_type"))
    end = F.regexp_extract("__name", r"^.+?(\.[^.]*)$", 1)
    parts = rows.withColumn("__name", whole).withColumn("__end", end).withColumn("__stem", F.expr("substring(__name, 1, length(__name) - length(__end))"))
    return numbered(parts, ["netloc", "__end"], "__stem", order, "filename", F.col("__end")).drop("__name", "__end", "__stem")


def write_tree(rows: DataFrame, root: str, kind: str, content: str) -> None:
    """Write each row (netloc, filename, ``content``: text or binary) as a file ``root/netloc/kind/filename`` from the executors; ``root`` is a folder that all of them have mounted.

    A file is written under another name and then moved, so a task that runs again replaces its own. Rows with a null content are left out.
    """
    source = rows.select("netloc", "filename", F.col(content).cast("binary").alias("content")).filter("content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        n = 0
        for b in batches:
            for netloc_, name, data in zip(*(c.to_pylist() for c in b.columns)):
                folder = os.path.join(root, netloc_.replace("/", "_").lstrip(".") or "_", kind)
                os.makedirs(folder, exist_ok=True)
                made = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(made, "wb") as f:
                    f.write(data)
                os.replace(made, os.path.join(folder, name or "_"))
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    source.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_list(urls: DataFrame, path: str) -> bool:
    """Write (url) as text lines, replacing an older list; nothing is written where there are none."""
    if urls.isEmpty():
        return False
    urls.select("url").orderBy("url").write.mode("overwrite").text(path)
    return True


def write_corpus(rows: DataFrame, path: str) -> None:
    """Write pages, texts or files as Parquet, a folder for each domain."""
    rows.write.mode("overwrite").partitionBy("netloc").parquet(path)
