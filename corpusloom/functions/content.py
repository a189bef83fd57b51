"""What a response is, as column expressions; and the decoding of its bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import DENIED_LENGTH, DENIED_PHRASE, FILE_MIMES
from corpusloom.functions.urls import downloadable


def mime(content_type: Column) -> Column:
    """The MIME type alone, in lower case; empty for null."""
    return F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))


def kind(url: Column, content_type: Column) -> Column:
    """``file`` by extension or MIME type, else ``html``, whatever the status."""
    return F.when(downloadable(url) | mime(content_type).isin(*FILE_MIMES), F.lit("file")).otherwise(F.lit("html"))


def charset(declared: Column) -> Column:
    """The charset to decode with: the declared one, but UTF-8 where it is missing or one of the two that are declared by default."""
    low = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    return F.when(low.isin("", "iso-8859-1", "windows-1252"), F.lit("utf-8")).otherwise(low)


def denied(status: Column, html: Column) -> Column:
    """Status 401 or 403, or a short page that says so."""
    return F.coalesce(status.isin(401, 403), F.lit(False)) | F.coalesce((F.length(html) < DENIED_LENGTH) & F.contains(html, F.lit(DENIED_PHRASE)), F.lit(False))


def outcome(kind_: Column, status: Column, html: Column, n_bytes: Column, failed: Column, max_bytes: int) -> Column:
    """failed, oversize, file, denied or page."""
    return F.when(failed, F.lit("failed")).when((kind_ == "file") & (n_bytes > max_bytes), F.lit("oversize")).when(kind_ == "file", F.lit("file")).when(denied(status, html), F.lit("denied")).otherwise(F.lit("page"))


@F.pandas_udf(T.StringType())
def decode(body: pd.Series, declared: pd.Series) -> pd.Series:
    """The text of a body: by its charset, or by UTF-8 with replacement characters where that fails or isn't known."""

    def one(b, c):
        if b is None:
            return None
        try:
            return bytes(b).decode(c or "utf-8")
        except (LookupError, UnicodeDecodeError):
            return bytes(b).decode("utf-8", "replace")

    return pd.Series([one(b, c) for b, c in zip(body, declared)])
