"""Main text of pages by patterns alone: the tier that SQL can express. The llm package has a better one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (pattern, replacement) in order.
STEPS = [
    (r"(?s)<!--.*?-->", ""),
    *[(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "") for t in ("script", "style", "noscript", "template", "nav", "header", "footer", "aside")],
    (r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|main|body|br|blockquote|button)\b[^>]*>", "\n"),
    (r"(?i)<(?:td|th)\b[^>]*>", " | "),
    (r"<[^>]*>", ""),
    (r"&nbsp;", " "), (r"&quot;", '"'), (r"&lt;", "<"), (r"&gt;", ">"), (r"&middot;", "·"), (r"&copy;", "©"), (r"&amp;", "&"),
    (r"[ \t\r\f]+", " "), (r" ?\n ?", "\n"), (r"\n+", "\n"), (r"^[\n ]+|[\n ]+$", ""),
]
BODY = r"(?is)<(?:article|main)\b[^>]*>(.*)</(?:article|main)\s*>"


def extract_text(html: Column) -> Column:
    """The text of a page's article, main element or whole markup, one line for each block; null where nothing is left."""
    inner = F.regexp_extract(html, BODY, 1)
    out = F.when(inner != "", inner).otherwise(html)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.when(out != "", out)


def distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): of each document its lines that aren't blank, each where it stands first."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("p", "line")).filter(F.rlike("line", F.lit(r"\S")))
    return lines.groupBy(id_col, "line").agg((F.min("p") + 1).cast("int").alias("line_no")).select(id_col, "line_no", "line")


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of all rows with one key the first in order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")
