"""SQL expressions and queries that give the same rows as the core's queries, for an engine with RE2 patterns."""

from __future__ import annotations

from corpusloom.config import DENIED_LENGTH, DENIED_PHRASE, EXCLUDES, EXTENSIONS, FILE_MIMES, MIME_EXTENSIONS, OTHER_MIME_EXTENSIONS, TRACKING
from corpusloom.operators.text import BODY, STEPS

_RFC = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PAR = r"(?s)^((?:.*/)?[^/;]*)(?:;([^/]*))?$"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(u: str) -> str:
    return rf"regexp_replace({u}, '^[\x00-\x20]+|[\t\r\n]', '', 'g')"


def part(u: str, k: int) -> str:
    return f"regexp_extract({clean(u)}, {lit(_RFC)}, {k})"


def scheme(u: str) -> str:
    return f"lower({part(u, 1)})"


def netloc(u: str) -> str:
    return part(u, 2)


def path(u: str) -> str:
    return f"regexp_extract({part(u, 3)}, {lit(_PAR)}, 1)"


def params(u: str) -> str:
    return f"regexp_extract({part(u, 3)}, {lit(_PAR)}, 2)"


def decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', '%20'))"


def encode(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def plain(u: str) -> str:
    """Normalised without the strip of tracking parameters."""
    whole = f"({scheme(u)} || '://' || {netloc(u)} || {path(u)} || CASE WHEN {part(u, 4)} <> '' THEN '?' || {part(u, 4)} ELSE '' END)"
    return f"CASE WHEN {whole} LIKE '%/' AND {path(u)} <> '/' THEN left({whole}, length({whole}) - 1) ELSE {whole} END"


def stripped(u: str) -> str:
    """A url, given as a simple name, without tracking parameters."""
    names = ", ".join(lit(t) for t in TRACKING)
    key = decode("split_part(p, '=', 1)")
    value = decode("CASE WHEN strpos(p, '=') > 0 THEN substr(p, strpos(p, '=') + 1) ELSE '' END")
    pairs = f"list_transform(list_filter(string_split({part(u, 4)}, '&'), lambda p: p <> '' AND {key} NOT IN ({names})), lambda p: {encode(key)} || '=' || {encode(value)})"
    q = f"array_to_string({pairs}, '&')"
    base = f"(CASE WHEN {scheme(u)} <> '' THEN {scheme(u)} || ':' ELSE '' END || CASE WHEN {netloc(u)} <> '' THEN '//' || {netloc(u)} ELSE '' END || {part(u, 3)})"
    return f"CASE WHEN {part(u, 4)} = '' THEN {u} ELSE {base} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END END"


def excluded(u: str, patterns=EXCLUDES) -> str:
    return "(" + (" OR ".join(f"regexp_matches({u}, {lit(p)})" for p in patterns) or "false") + ")"


def downloadable(u: str) -> str:
    ext = "|".join(e.replace(".", r"\.") for e in EXTENSIONS)
    return f"regexp_matches(lower({path(u)}), '({ext})$')"


def mime(c: str) -> str:
    return f"trim(split_part(lower(coalesce({c}, '')), ';', 1))"


def kind(u: str, c: str) -> str:
    return f"CASE WHEN {downloadable(u)} OR {mime(c)} IN ({', '.join(lit(m) for m in FILE_MIMES)}) THEN 'file' ELSE 'html' END"


def denied(status: str, html: str) -> str:
    return f"(coalesce({status} IN (401, 403), false) OR coalesce(length({html}) < {DENIED_LENGTH} AND contains({html}, {lit(DENIED_PHRASE)}), false))"


def stem(u: str) -> str:
    inner = f"regexp_replace({path(u)}, '^/+|/+$', '', 'g')"
    return rf"CASE WHEN {inner} = '' THEN 'index' ELSE regexp_replace(regexp_replace(replace({inner}, '/', '_'), '\.html$', ''), '[^\p{{L}}\p{{N}}_\s\-.]', '_', 'g') END"


def extension(u: str, c: str) -> str:
    own = rf"lower(regexp_extract({path(u)}, '(\.[^./]*)$', 1))"
    cases = " ".join(f"WHEN {lit(m)} THEN {lit(e)}" for m, e in {**MIME_EXTENSIONS, **OTHER_MIME_EXTENSIONS}.items())
    return f"CASE WHEN {own} IN ({', '.join(lit(e) for e in EXTENSIONS)}) THEN {own} ELSE coalesce(CASE {mime(c)} {cases} END, '.bin') END"


def file_name(u: str, c: str) -> str:
    return rf"CASE WHEN {path(u)} = '' OR {path(u)} LIKE '%/' THEN 'file_' || left(md5({u}), 12) || {extension(u, c)} ELSE regexp_replace(list_extract(string_split({path(u)}, '/'), -1), '[^\p{{L}}\p{{N}}_\s\-.]', '_', 'g') END"


def extract_text(h: str) -> str:
    inner = f"regexp_extract({h}, {lit(BODY)}, 1)"
    out = f"CASE WHEN {inner} <> '' THEN {inner} ELSE {h} END"
    for pattern, to in STEPS:
        out = f"regexp_replace({out}, {lit(pattern)}, {'chr(10)' if to == chr(10) else lit(to)}, 'g')"
    return f"nullif({out}, '')"


#: Common tables.
URLS = f"urls AS (SELECT url, base_domain, visited_at, outcome, attempts, {plain('url')} AS u0 FROM visited)"
PAGES = f"pg AS (SELECT page_id, url, http_status, content_type, content, html_content, fetched_at, {plain('url')} AS u0 FROM pages)"
NORM = f"pn AS (SELECT *, {stripped('u0')} AS u FROM pg)"
HREFS = r"""hrefs AS (SELECT DISTINCT page_id, url, href FROM (SELECT page_id, url, unnest(regexp_extract_all(html_content, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages WHERE html_content IS NOT NULL))"""
RESOLVED = f"""res AS (SELECT page_id, {netloc('url')} AS netloc, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href ELSE {scheme('url')} || '://' || {netloc('url')} || href END AS a FROM hrefs),
r0 AS (SELECT page_id, netloc, {plain('a')} AS u0 FROM res), links AS (SELECT DISTINCT page_id, netloc, {stripped('u0')} AS norm_url FROM r0)"""
CORPUS = "corpus AS (SELECT u, min(page_id) AS page_id FROM pn GROUP BY u)"
EDGES = """edges AS (SELECT DISTINCT '/c/' || o_custkey AS src, '/o/' || o_orderkey AS dst FROM orders
UNION SELECT '/o/' || l_orderkey, '/p/' || l_partkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT '/p/' || l_partkey, '/s/' || l_suppkey FROM lineitem WHERE l_linenumber = 1
UNION SELECT '/s/' || s_suppkey, '/c/' || s_suppkey FROM supplier)"""
SITEMAPS = f"""maps AS (SELECT {netloc('url')} AS host, page_id, url FROM pages)"""
SEEDS = f"sd AS (SELECT page_id AS ord, url, {netloc('url')} AS netloc FROM pages)"
VSTATS = """v AS (SELECT base_domain AS netloc, url, min(outcome) AS outcome FROM visited GROUP BY 1, 2)"""
OUT = f"""SELECT p.page_id, p.url, CASE WHEN {kind('url', 'content_type')} = 'file' AND strlen(content) > 5000 THEN 'oversize' WHEN {kind('url', 'content_type')} = 'file' THEN 'file' WHEN content IS NULL AND http_status IS NULL THEN 'failed' WHEN {denied('http_status', 'content')} THEN 'denied' ELSE 'page' END AS outcome FROM pages p"""

SQL = {
    "url_parts": f"SELECT page_id, {scheme('url')} AS scheme, {netloc('url')} AS netloc, {path('url')} AS path, {params('url')} AS params, {part('url', 4)} AS query, {part('url', 5)} AS fragment FROM pages",
    "url_domain": f"SELECT page_id, {netloc('url')} AS netloc FROM pages",
    "normalize_url": f"SELECT page_id, {plain('url')} AS url_norm FROM pages",
    "strip_tracking": f"WITH {URLS} SELECT url, {stripped('u0')} AS url_norm, count(*) AS n FROM urls GROUP BY 1, 2",
    "url_distinct": f"WITH {PAGES}, {NORM} SELECT u AS url_norm, min(page_id) AS page_id FROM pn GROUP BY 1",
    "exclude_filter": f"SELECT DISTINCT url, {excluded('url')} AS excluded FROM visited",
    "exclude_custom": f"SELECT DISTINCT url, {excluded('url', ('[?]page=', chr(92) + '.zip$'))} AS excluded FROM visited",
    "download_filter": f"SELECT DISTINCT url, {downloadable('url')} AS is_download FROM visited",
    "classify_kind": f"SELECT url, {kind('url', 'ct')} AS kind FROM (SELECT DISTINCT url, content_type AS ct FROM pages UNION SELECT DISTINCT url, NULL FROM visited)",
    "charset_choice": "SELECT page_id, CASE WHEN lower(trim(coalesce(declared_charset, ''))) IN ('', 'iso-8859-1', 'windows-1252') THEN 'utf-8' ELSE lower(trim(declared_charset)) END AS encoding FROM pages",
    "denied_detect": f"SELECT page_id, {denied('http_status', 'content')} AS denied FROM pages",
    "oversize_filter": "SELECT page_id, strlen(content) > 4000 AS oversize FROM pages WHERE content IS NOT NULL",
    "page_stem": f"SELECT page_id, {stem('url')} AS stem FROM pages",
    "file_name": f"SELECT DISTINCT url, {file_name('url', 'NULL')} AS filename FROM visited",
    "file_ext": f"SELECT url, {extension('url', 'ct')} AS ext FROM (SELECT DISTINCT url, content_type AS ct FROM pages UNION SELECT DISTINCT url, NULL FROM visited)",
    "collision_suffix": f"""WITH s AS (SELECT {netloc('url')} AS netloc, page_id, {stem('url')} AS stem FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY netloc, stem ORDER BY page_id) - 1 AS k FROM s), f AS (SELECT *, CASE WHEN k = 0 THEN stem ELSE stem || '_' || k END AS f FROM n),
m AS (SELECT *, min(k) OVER (PARTITION BY netloc, f) AS j FROM f)
SELECT netloc, page_id, CASE WHEN k > 0 AND j = 0 THEN stem || '~' || k ELSE f END || '.html' AS filename FROM m""",
    "file_dedup": "SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL GROUP BY 2",
    "extract_links": f"WITH {HREFS} SELECT page_id, href FROM hrefs",
    "resolve_links": f"WITH {HREFS}, {RESOLVED} SELECT page_id, norm_url FROM links",
    "same_domain_links": f"WITH {HREFS}, {RESOLVED} SELECT page_id, norm_url FROM links WHERE norm_url LIKE 'http%' AND {netloc('norm_url')} = netloc AND NOT {excluded('norm_url')}",
    "asset_links": f"SELECT DISTINCT url, base_domain AS netloc FROM visited WHERE url LIKE 'http%' AND {downloadable('url')}",
    "extract_text": f"SELECT page_id, {extract_text('html_content')} AS text FROM pages",
    "text_dedup": """SELECT doc_id, CAST(min(n) AS INTEGER) AS line_no, line FROM (SELECT doc_id, u.n, list_extract(string_split(text, chr(10)), u.n) AS line FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS n) u WHERE text IS NOT NULL)
WHERE regexp_matches(line, '\\S') GROUP BY doc_id, line""",
    "seed_collect": "SELECT page_id AS ord, url FROM pages UNION ALL SELECT page_id, url FROM pages WHERE html_content IS NULL",
    "seeds_by_domain": f"WITH {SEEDS} SELECT netloc, arg_min(url, ord) AS start_url, count(*) - 1 AS n_extra FROM sd WHERE netloc <> '' GROUP BY 1",
    "sitemap_locs": f"WITH {SITEMAPS} SELECT host, url AS loc FROM maps WHERE regexp_matches(url, '^https') GROUP BY 1, 2",
    "sitemap_seed": f"""WITH {SITEMAPS}, d AS (SELECT host, url, min(page_id) AS o FROM maps GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY o) AS rnk FROM d),
t AS (SELECT host, rnk, {plain('url')} AS u0 FROM r WHERE rnk <= 20), n AS (SELECT host, rnk, {stripped('u0')} AS url_norm FROM t)
SELECT host, url_norm, min(rnk) AS rnk FROM n WHERE {netloc('url_norm')} = host AND NOT {excluded('url_norm')} GROUP BY 1, 2""",
    "frontier_antijoin": f"WITH {HREFS}, {RESOLVED}, {URLS}, vn AS (SELECT DISTINCT {stripped('u0')} AS u FROM urls) SELECT DISTINCT netloc, norm_url AS url FROM links WHERE NOT EXISTS (SELECT 1 FROM vn WHERE vn.u = norm_url)",
    "frontier_batch": f"WITH {HREFS}, {RESOLVED}, d AS (SELECT DISTINCT netloc, norm_url AS url FROM links) SELECT netloc, url FROM (SELECT *, row_number() OVER (PARTITION BY netloc ORDER BY url) AS k FROM d) WHERE k <= 100",
    "fetch_corpus": f"WITH {HREFS}, {RESOLVED}, {PAGES}, {NORM}, {CORPUS}, f AS (SELECT DISTINCT norm_url AS url FROM links UNION SELECT u FROM corpus) SELECT f.url, c.page_id IS NOT NULL AS found FROM f LEFT JOIN corpus c ON f.url = c.u",
    "url_outcome": f"SELECT page_id, url, outcome FROM ({OUT})",
    "crawl_closure": f"WITH RECURSIVE {EDGES}, r AS (SELECT '/c/1' AS url UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.url) SELECT url FROM r",
    "bfs_depth": f"WITH RECURSIVE {EDGES}, r AS (SELECT '/c/1' AS url, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.url WHERE r.depth < 12) SELECT url, min(depth) AS depth FROM r GROUP BY url",
    "multi_domain_crawl": f"""WITH RECURSIVE {HREFS.replace('html_content', 'content')}, {RESOLVED}, {PAGES}, {NORM}, {CORPUS}, s AS (SELECT {netloc('u')} AS netloc, arg_min(u, page_id) AS u FROM pn GROUP BY 1),
hop AS (SELECT c.u AS src, l.netloc, l.norm_url AS dst FROM corpus c JOIN links l ON l.page_id = c.page_id WHERE {netloc('l.norm_url')} = l.netloc AND NOT {excluded('l.norm_url')}),
r AS (SELECT netloc, u AS url FROM s UNION SELECT h.netloc, h.dst FROM r JOIN hop h ON h.src = r.url) SELECT netloc, count(DISTINCT url) AS visited FROM r GROUP BY 1""",
    "crawl_stats": f"""WITH o AS ({OUT}), j AS (SELECT {netloc('o.url')} AS netloc, o.outcome, page_id, strlen(p.content) AS n FROM o JOIN pages p USING (page_id))
SELECT netloc, count(*) FILTER (outcome = 'page') AS pages_downloaded, count(*) FILTER (outcome = 'file') AS files_downloaded, count(*) FILTER (outcome = 'page' AND page_id IN (SELECT page_id FROM text_out WHERE regexp_matches(extracted_text, '\\S') AND page_id IS NOT NULL)) AS text_extracted, count(*) FILTER (outcome = 'failed') AS errors, count(*) FILTER (outcome = 'denied') AS denied,
CAST(coalesce(sum(n) FILTER (outcome IN ('page', 'file')), 0) AS BIGINT) AS total_bytes FROM j GROUP BY 1""",
    "visited_count": "SELECT base_domain AS netloc, count(DISTINCT url) AS visited FROM visited GROUP BY 1",
    "denied_urls": "SELECT DISTINCT url FROM visited WHERE outcome = 'denied'",
    "failed_urls": "SELECT DISTINCT url FROM visited WHERE outcome = 'failed'",
    "retry_outcome": "SELECT url, CAST(max(least(coalesce(attempts, 0), 3)) AS INTEGER) AS attempts, CASE WHEN max(coalesce(attempts, 0)) >= 3 AND count(*) FILTER (outcome IS NULL OR outcome <> 'failed') = 0 THEN 'failed' ELSE 'done' END AS outcome FROM visited GROUP BY url",
    "resume_frontier": f"WITH RECURSIVE {EDGES}, r AS (SELECT '/c/1' AS url, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.url WHERE r.depth < 4), d AS (SELECT url, min(depth) AS depth FROM r GROUP BY url) SELECT url FROM d WHERE depth = 3",
    "page_sink": f"""WITH s AS (SELECT {netloc('url')} AS netloc, page_id, {stem('url')} AS stem, strlen(content) AS b FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY netloc, stem ORDER BY page_id) - 1 AS k FROM s), f AS (SELECT *, CASE WHEN k = 0 THEN stem ELSE stem || '_' || k END AS f FROM n),
m AS (SELECT *, min(k) OVER (PARTITION BY netloc, f) AS j FROM f)
SELECT netloc, page_id, CASE WHEN k > 0 AND j = 0 THEN stem || '~' || k ELSE f END || '.html' AS filename, CAST(b AS BIGINT) AS n_bytes FROM m""",
    "text_sink": f"""WITH s AS (SELECT {netloc('url')} AS netloc, text_id, {stem('url')} AS stem FROM text_out WHERE regexp_matches(extracted_text, '\\S')),
n AS (SELECT *, row_number() OVER (PARTITION BY netloc, stem ORDER BY text_id) - 1 AS k FROM s), f AS (SELECT *, CASE WHEN k = 0 THEN stem ELSE stem || '_' || k END AS f FROM n),
m AS (SELECT *, min(k) OVER (PARTITION BY netloc, f) AS j FROM f)
SELECT netloc, text_id, CASE WHEN k > 0 AND j = 0 THEN stem || '~' || k ELSE f END || '.txt' AS filename FROM m""",
    "progress_window": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY 1",
}
SQL["crawl_summary"] = f"SELECT CAST(sum(pages_downloaded) AS BIGINT) AS pages_downloaded, CAST(sum(files_downloaded) AS BIGINT) AS files_downloaded, CAST(sum(text_extracted) AS BIGINT) AS text_extracted, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(denied) AS BIGINT) AS denied, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, round(sum(total_bytes) / 1048576.0, 2) AS total_mib FROM ({SQL['crawl_stats']})"
SQL["page_names_distinct"] = f"SELECT {netloc('url')} AS netloc, count(*) AS n_pages, count(*) AS n_names FROM pages GROUP BY 1"
SQL["file_sink"] = f"""WITH v AS (SELECT DISTINCT base_domain AS netloc, url FROM visited WHERE {downloadable('url')}), w AS (SELECT netloc, url, {file_name('url', 'NULL')} AS whole FROM v),
e AS (SELECT *, regexp_extract(whole, '^.+?(\\.[^.]*)$', 1) AS ending FROM w), s AS (SELECT *, left(whole, length(whole) - length(ending)) AS stem FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY netloc, ending, stem ORDER BY url) - 1 AS k FROM s), f AS (SELECT *, CASE WHEN k = 0 THEN stem ELSE stem || '_' || k END AS f FROM n),
m AS (SELECT *, min(k) OVER (PARTITION BY netloc, ending, f) AS j FROM f) SELECT netloc, url, CASE WHEN k > 0 AND j = 0 THEN stem || '~' || k ELSE f END || ending AS filename FROM m"""
SQL["stats_roundtrip"] = SQL["crawl_stats"]
