"""Names of stored files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.config import EXTENSIONS, MIME_EXTENSIONS, OTHER_MIME_EXTENSIONS
from corpusloom.functions.content import mime
from corpusloom.functions.urls import path

#: What isn't a word character (of any script), white space, hyphen or dot.
UNSAFE = r"[^\p{L}\p{N}_\s\-.]"


def page_stem(url: Column) -> Column:
    """The path without slashes at its ends, others as underscores, without ``.html`` at the end; ``index`` for the root."""
    inner = F.regexp_replace(path(url), r"^/+|/+$", "")
    return F.when(inner == "", F.lit("index")).otherwise(F.regexp_replace(F.regexp_replace(F.replace(inner, F.lit("/"), F.lit("_")), r"\.html$", ""), UNSAFE, "_"))


def file_extension(url: Column, content_type: Column) -> Column:
    """The path's extension if it is one of files, else that of the MIME type, else ``.bin``."""
    own = F.lower(F.regexp_extract(path(url), r"(\.[^./]*)$", 1))
    known = {**MIME_EXTENSIONS, **OTHER_MIME_EXTENSIONS}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.when(own.isin(*EXTENSIONS), own).otherwise(F.coalesce(F.try_element_at(table, mime(content_type)), F.lit(".bin")))


def file_name(url: Column, content_type: Column) -> Column:
    """The last segment of the path; where there is none, ``file_``, twelve digits of the url's MD5 and the extension."""
    p = path(url)
    made = F.concat(F.lit("file_"), F.substring(F.md5(url.cast("binary")), 1, 12), file_extension(url, content_type))
    return F.when((p == "") | F.endswith(p, F.lit("/")), made).otherwise(F.regexp_replace(F.element_at(F.split(p, "/"), -1), UNSAFE, "_"))


def numbered(df: DataFrame, group: list[str], stem: str, order: list[str], out: str, extension: str | Column = "") -> DataFrame:
    """``out``: ``stem``, or ``stem_1``, ``stem_2`` and so on where rows of a group share it, in the given order; then the extension. No two rows of a group get one name.

    Two made names can't be the same, since their last number tells their stems. One that is also the stem of another row becomes ``stem~1``: a tilde stands in no stem (``UNSAFE``).
    """
    n = F.row_number().over(W.partitionBy(*group, stem).orderBy(*order)) - 1
    made = F.concat(F.col(stem), F.lit("_"), F.col("__n").cast("string"))
    named = df.withColumn("__n", n).withColumn(out, F.when(F.col("__n") == 0, F.col(stem)).otherwise(made))
    taken = F.min("__n").over(W.partitionBy(*group, out)) == 0
    apart = F.when((F.col("__n") > 0) & F.col("__taken"), F.concat(F.col(stem), F.lit("~"), F.col("__n").cast("string"))).otherwise(F.col(out))
    end = F.lit(extension) if isinstance(extension, str) else extension
    return named.withColumn("__taken", taken).withColumn(out, F.concat(apart, end)).drop("__n", "__taken")
