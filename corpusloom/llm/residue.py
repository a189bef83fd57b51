"""Problem 6: unfilled templates, filler, error pages and demands for scripts in place of content.

Records of one site are taken as made from one template: the lines that recur over its pages are its fixed part, all others fill its slots. A record is
found if every slot retains variable names (unfilled slots in the syntax of a template language), defaults (filler text), or blanks beside a message
that recurs as the whole body of pages, or whose words are those of errors and demands.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.lines import filler_words, hash64, record_lines
from corpusloom.plans.joins import sized_join
from corpusloom.plans.storage import materialize

#: A line is of a site's template if it stands under so many urls and this share of the site's urls.
FIXED_URLS, FIXED_SHARE = 4, 0.06
#: So many lines after the heading of a list of other pages may be its entries.
ENTRIES = 5
#: A message is an error template if it stands as (part of) the whole body under so many urls. A body of messages and lines that recur has at most so many letters, unless this share of them is of messages.
MESSAGE_URLS, MESSAGE_LETTERS, MESSAGE_SHARE = 3, 600, 0.5
#: A line is a message if it has a cue for every so many characters.
CUE_SPAN = 160
#: Rows of a side of a join that may be broadcast, here where many joins are held by the driver at once; beyond, both sides are shuffled.
HELD = 20_000
#: Parts of words of error messages and demands for scripts.
CUES = (
    "javascript", "enable scripts", "turn on scripts", "error 404", "error 403", "error 500", "404 –", "404 -", "page not found", "could not be found", "no longer exist", "access denied", "not allowed", "may not view", "too many requests",
    "session has timed out", "down for maintenance", "something went wrong", "checking your browser", "sign in to continue", "could not reach the database", "nothing here but", "please reload", "reload the page", "service unavailable",
    "internal server error", "bad gateway", "forbidden", "erreur", "introuvable", "n’existe plus", "un problème est survenu", "site en maintenance", "vérification de votre navigateur", "fehler 404", "nicht gefunden", "existiert nicht mehr",
    "etwas schiefgelaufen", "wartungsarbeiten", "ihr browser wird", "página no encontrada", "no se ha encontrado", "ya no existe", "algo salió mal", "algo ha salido mal", "en mantenimiento", "comprobando su navegador", "não foi encontrada",
    "já não existe", "não existe mais", "algo correu mal", "em manutenção", "verificar o seu navegador", "errore 404", "non è stata trovata", "non esiste più", "qualcosa è andato storto", "in manutenzione", "controllo del browser", "fout 404",
    "niet gevonden", "bestaat niet meer", "ging iets mis", "onderhoud", "uw browser wordt", "błąd 404", "nie została znaleziona", "nie istnieje", "coś poszło nie tak", "przerwa techniczna", "sprawdzamy przeglądarkę", "ошибка 404",
    "не найдена", "больше не существует", "что-то пошло не так", "техническ", "проверяем ваш браузер", "помилка 404", "не знайдено", "sidan kunde inte hittas", "något gick fel", "sayfa bulunamadı", "bir şeyler ters gitti", "δεν βρέθηκε",
    "κάτι πήγε στραβά", "is not defined", "fatal:", "request blocked", "contact the owner", "stack trace", "algo ha fallado", "qualcosa non va", "браузер", "przeglądark", "navegador", "navigateur", "your browser", "ihr browser", "im browser", "uw browser",
    "del browser", "tarayıcı", "webbläsare", "ブラウザ", "浏览器", "web server", "webmaster", "見つかりません", "エラー", "找不到页面", "页面不存在", "出错了",
)
_CODE = re.compile(r"^ref\. \S+$|^\W*(?:404|403|500|503|429)\b", re.I)


@lru_cache(maxsize=1)
def _cues():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in CUES:
        a.add_word(c, len(c))
    a.make_automaton()
    return a


def message(line: str) -> bool:
    """Whether a line has the words of an error message or a demand for scripts, a long one all along."""
    n, last = 0, -1
    for end, size in _cues().iter(line.lower()):
        if end - size >= last:
            n, last = n + 1, end
    return (n or _CODE.match(line) is not None) * CUE_SPAN > len(line)


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """``sized_join`` within ``HELD``. The lines of one record are few, so joins by record need no salt."""
    return sized_join(left, right, on, how, limit=HELD, salt=1 if on == ["kind", "id"] else 16)


def template_lines(lines: DataFrame) -> DataFrame:
    """(kind, site, key, masked): the fixed lines of each site's template; a line and a url count once."""
    body = lines.filter("no > 0")
    urls = lines.filter("no = 0").select("kind", "site", "url").distinct().groupBy("kind", "site").agg(F.count("*").alias("n_site"))
    seen = body.select("kind", "site", "key", "masked", "url").distinct().groupBy("kind", "site", "key").agg(F.count("*").alias("n"), F.first("masked").alias("masked")).filter(F.col("n") >= FIXED_URLS)
    return seen.join(urls, ["kind", "site"]).filter(F.col("n") >= FIXED_SHARE * F.col("n_site")).select("kind", "site", "key", "masked", (F.col("n") / F.col("n_site")).alias("share"))


def slots(lines: DataFrame) -> DataFrame:
    """The line table without the template's fixed lines: those of the record's own site, and lines that are fixed on any other.

    A line that is unfilled, filler or a message stays, unless it stands on a third of its site's urls and so is furniture itself.
    """
    fixed = materialize(template_lines(lines), "fixed")
    own = _join(lines.filter("no > 0"), fixed.select("kind", "site", "key", "share"), ["kind", "site", "key"], "left")
    anywhere = fixed.select("masked").filter("masked <> 0").distinct().withColumn("known", F.lit(True))
    both = _join(own, anywhere, ["masked"], "left")
    odd = F.col("cls").isin(1, 2, 3)
    fixed_here = (F.col("share").isNotNull() & ~odd) | (F.coalesce("share", F.lit(0.0)) > 0.34)
    return both.filter(~(fixed_here | (F.col("known").isNotNull() & ~odd))).drop("share", "known")


def without_entries(left: DataFrame, lines: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """Slots (``slots``) without the entries of lists of other pages. ``headings``: (masked) of lines known as headings of such lists, beside those of the pages in ``lines``."""
    odd = F.col("cls").isin(1, 2, 3)
    # entries of lists of other pages fill no slot of the body: links of pages, and what follows in texts the lines that pages have as headings of such
    own = lines.filter("cls = 6").select("masked")
    headings = materialize((own.unionByName(headings) if headings is not None else own).filter("masked <> 0").distinct(), "headings")
    at = _join(lines.filter("no > 0 and kind = 'text'").select("id", "no", "masked"), headings, ["masked"], "left_semi").groupBy("id").agg(F.collect_set("no").alias("heads")).select(F.lit("text").alias("kind"), "id", "heads")
    j = left.join(at, ["kind", "id"], "left")
    entry = F.coalesce(F.exists("heads", lambda h: (F.col("no") > h) & (F.col("no") <= h + ENTRIES)), F.lit(False)) | ((F.col("kind") == "page") & (F.col("links") >= 0.8 * F.col("letters")) & (F.col("letters") > 0))
    return j.filter(odd | ~entry).filter("cls <> 6").drop("heads")


def line_table(records: DataFrame) -> DataFrame:
    """The table of lines (``SCHEMA``) of records (record_kind, record_id, site, url, body), written."""
    return materialize(record_lines(records, filler_words(records), message), "lines")


def residue(lines: DataFrame, headings: DataFrame | None = None, filled: DataFrame | None = None) -> DataFrame:
    """(record_kind, record_id) of the records of a ``line_table`` whose body is nothing but such residue; ``headings`` as of ``without_entries``; ``filled``: ``slots`` of the table, if known.

    Records with a null or blank body, or with nothing but lines of the template, aren't found. Repeated rows come out once. Empty tables give no rows.
    """
    filled = materialize(slots(lines), "filled") if filled is None else filled
    left = materialize(without_entries(filled, lines, headings), "slots")
    seen = left.filter("cls = 0 and letters > 0").select("masked", "url").distinct().groupBy("masked").agg(F.count("*").alias("n")).filter(F.col("n") >= MESSAGE_URLS)
    again = materialize(seen.select("masked", F.lit(True).alias("again")), "again")
    marked = _join(left, again, ["masked"], "left")
    odd = F.col("cls").isin(1, 2, 3)
    per = marked.groupBy("kind", "id").agg(
        F.sum(odd.cast("int")).alias("n_odd"), F.sum((~odd & (F.col("cls") != 5) & F.col("again").isNull() & (F.col("letters") > 0)).cast("int")).alias("n_plain"),
        F.sum(F.when(F.col("cls").isin(1, 2), 0).otherwise(F.col("letters"))).alias("said"), F.sum(F.when(F.col("cls") == 3, F.col("letters")).otherwise(0)).alias("told"),
    )
    # other lines beside messages must be short; where only recurring lines are left, one of them must be a known message, or all of repeated_bodies
    known = per.filter((F.col("n_plain") == 0) & (F.col("n_odd") > 0) & ((F.col("said") <= MESSAGE_LETTERS) | (F.col("told") >= MESSAGE_SHARE * F.col("said")))).select("kind", "id")
    return known.unionByName(repeated_bodies(lines, filled, again)).distinct().select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"))


def repeated_bodies(lines: DataFrame, filled: DataFrame, again: DataFrame) -> DataFrame:
    """(kind, id) of the records whose body is an error template by repetition alone, whatever its words.

    A record is bare if it has no slots (``filled``) but known residue, the site's name and lines that recur (``again``), and no links of its own. Lines under ``MESSAGE_URLS`` urls or more that
    stand in bare records only are messages: furniture stands beside content too. What a record has of them may be longer the more urls it stands under, since an article under a few urls is no message.
    """
    own = _join(filled.filter("letters > 0 and cls not in (1, 2, 3, 5)"), again, ["masked"], "left")
    content = own.filter("again is null or links >= 0.8 * letters").select("kind", "id").distinct()
    bare = materialize(_join(lines.filter("no = 0").select("kind", "id").distinct(), content, ["kind", "id"], "left_anti"), "bare")
    body = lines.filter("no > 0 and letters > 0 and cls not in (1, 2, 3, 5)").filter(F.col("masked") != hash64("")).select("kind", "id", "masked", "letters", "url")
    inside = materialize(_join(body, bare, ["kind", "id"], "left_semi"), "inside")
    often = materialize(inside.groupBy("masked").agg(F.countDistinct("url").alias("n_urls")).filter(F.col("n_urls") >= MESSAGE_URLS), "often")
    beside = _join(_join(body.select("kind", "id", "masked"), often.select("masked"), ["masked"], "left_semi"), bare, ["kind", "id"], "left_anti").select("masked").distinct()
    only = materialize(_join(often, beside, ["masked"], "left_anti"), "messages")
    per = _join(inside, only, ["masked"], "inner").groupBy("kind", "id").agg(F.sum("letters").alias("said"), F.min("n_urls").alias("n_urls"))
    return per.filter(F.col("said") * MESSAGE_URLS <= F.col("n_urls") * MESSAGE_LETTERS).select("kind", "id")
