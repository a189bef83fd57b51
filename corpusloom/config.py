"""Settings of a crawl, and the constants that its results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Extensions and MIME types of files that are downloaded rather than parsed.
EXTENSIONS = (".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".txt", ".csv", ".zip", ".rtf", ".odt", ".ods", ".odp")
#: MIME type -> extension of the files; and of a few other types that a name may need.
MIME_EXTENSIONS = {
    "application/pdf": ".pdf",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-powerpoint": ".ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "text/plain": ".txt",
    "text/csv": ".csv",
    "application/zip": ".zip",
    "application/rtf": ".rtf",
    "application/vnd.oasis.opendocument.text": ".odt",
    "application/vnd.oasis.opendocument.spreadsheet": ".ods",
    "application/vnd.oasis.opendocument.presentation": ".odp",
}
FILE_MIMES = tuple(MIME_EXTENSIONS)
OTHER_MIME_EXTENSIONS = {"text/html": ".html", "application/octet-stream": ".bin", "image/png": ".png"}
#: Patterns of urls that are left out by default, searched in the whole url.
EXCLUDES = (r"/tag/", r"/author/", r"/feed/?$", r"/print/", r"\?print=", r"/comments/", r"/page/\d+", r"/cdn-cgi/")
#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_eid", "mc_cid", "ref", "_ga", "_gl", "igshid", "msclkid", "dclid")
#: The phrase of pages that deny access, and the length in characters below which it counts.
DENIED_PHRASE, DENIED_LENGTH = "Access Denied", 2000


@dataclass(frozen=True)
class CrawlConfig:
    """Settings of one crawl. ``None`` means no limit. ``round_urls``: so many urls of a domain are fetched in one round, the rest wait; ``per_host``: so many at a time."""

    max_concurrent: int = 100
    timeout: float = 30.0
    max_retries: int = 3
    delay: float = 0.1
    max_file_bytes: int = 100 * 1024 * 1024
    strip_tracking: bool = True
    use_sitemap: bool = True
    max_sitemap_urls: int = 5000
    excludes: tuple[str, ...] = field(default=EXCLUDES)
    strict_domain: bool = False
    max_rounds: int | None = None
    round_urls: int | None = None
    per_host: int = 100
    user_agent: str = "corpusloom/0.1"


def exclude_patterns(extra: list[str] | None = None, defaults: bool = True) -> tuple[str, ...]:
    """The default patterns, if wanted, and then a user's own."""
    return (*(EXCLUDES if defaults else ()), *(extra or ()))
