"""URLs as column expressions: parsing, normalising, filtering and resolving, all within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import EXCLUDES, EXTENSIONS, TRACKING

#: RFC 3986, appendix B: scheme, authority, path, query, fragment.
PATTERN = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: The path and the parameters of its last segment.
PARAMS = r"(?s)^((?:.*/)?[^/;]*)(?:;([^/]*))?$"


def clean(url: Column) -> Column:
    """Without leading control characters and spaces, and without tabs and line ends anywhere."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(clean(url), PATTERN, 1))


def netloc(url: Column) -> Column:
    """The authority as written: case, port and user stay."""
    return F.regexp_extract(clean(url), PATTERN, 2)


def whole_path(url: Column) -> Column:
    return F.regexp_extract(clean(url), PATTERN, 3)


def path(url: Column) -> Column:
    return F.regexp_extract(whole_path(url), PARAMS, 1)


def params(url: Column) -> Column:
    return F.regexp_extract(whole_path(url), PARAMS, 2)


def query(url: Column) -> Column:
    return F.regexp_extract(clean(url), PATTERN, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(clean(url), PATTERN, 5)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(url: Column) -> Column:
    """[scheme as written, authority, path, query, fragment] by one match."""
    return F.split(F.regexp_replace(clean(url), PATTERN, "$1\x01$2\x01$3\x01$4\x01$5"), "\x01")


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def strip_tracking(url: Column, names: tuple[str, ...] = TRACKING) -> Column:
    """The url without query parameters of these names, compared after decoding; the others are decoded and encoded again in their order.

    A url without query stays as it is, else its fragment goes too.
    """
    key = lambda p: _decode(F.substring_index(p, "=", 1))
    value = lambda p: _decode(F.when(F.contains(p, F.lit("=")), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise(F.lit("")))
    keep = lambda p: (p != "") & ~key(p).isin(*names) if names else p != ""

    def cleaned(query_: Column) -> Column:
        return F.array_join(F.transform(F.filter(F.split(query_, "&"), keep), lambda p: F.concat(_encode(key(p)), F.lit("="), _encode(value(p)))), "&")

    def of(u: Column) -> Column:
        def build(x: Column) -> Column:
            base = F.concat(F.when(x[0] != "", F.concat(F.lower(x[0]), F.lit(":"))).otherwise(F.lit("")), F.when(x[1] != "", F.concat(F.lit("//"), x[1])).otherwise(F.lit("")), x[2])
            return F.when(x[3] == "", u).otherwise(let(cleaned(x[3]), lambda q: F.concat(base, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))))

        return let(parts(u), build)

    return let(url, of)


def normalize(url: Column, tracking: bool = False) -> Column:
    """scheme://netloc/path?query, without parameters of the path and fragment; one slash at the very end is dropped unless the path is only that.

    With ``tracking`` tracking parameters are stripped after that, so a slash before them stays. A null url stays null.
    """

    def build(x: Column) -> Column:
        def finish(p: Column) -> Column:
            plain = F.concat(F.lower(x[0]), F.lit("://"), x[1], p, F.when(x[3] != "", F.concat(F.lit("?"), x[3])).otherwise(F.lit("")))
            return let(plain, lambda w: F.when(F.endswith(w, F.lit("/")) & (p != "/"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))

        return let(F.regexp_extract(x[2], PARAMS, 1), finish)

    cut = F.when(url.isNotNull(), let(parts(url), build))
    return strip_tracking(cut) if tracking else cut


def excluded(url: Column, patterns: tuple[str, ...] = EXCLUDES) -> Column:
    """Whether any pattern is found in the url; without patterns never."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(url, F.lit(p))
    return out


def downloadable(url: Column) -> Column:
    """Whether the path, in any case of letters, ends with an extension of files."""
    return F.rlike(F.lower(path(url)), F.lit("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$"))


def resolve(base: Column, href: Column) -> Column:
    """``href`` against the url ``base`` by RFC 3986; dot segments are taken out by ``remove_dots``."""
    h = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]", "")
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_extract(whole_path(base), r"(?s)^(.*/)?", 0)
    asked = F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise(F.lit(""))
    return (
        F.when(F.rlike(h, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme(base), F.lit(":"), h))
        .when(h == "", F.concat(root, whole_path(base), asked))
        .when(F.startswith(h, F.lit("#")), F.concat(root, whole_path(base), asked, h))
        .when(F.startswith(h, F.lit("?")), F.concat(root, whole_path(base), h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, remove_dots(h)))
        .otherwise(F.concat(root, remove_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), h))))
    )


def remove_dots(p: Column) -> Column:
    """A rooted path, with or without query, without its segments ``.`` and ``..``."""
    split_at = F.regexp_extract(p, r"(?s)^([^?#]*)(.*)$", 1)
    rest = F.regexp_extract(p, r"(?s)^([^?#]*)(.*)$", 2)
    parts = F.split(split_at, "/")
    folded = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    last = F.element_at(parts, -1)
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"), F.when(last.isin(".", "..") & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(F.rlike(split_at, F.lit(r"(^|/)\.\.?(/|$)")), F.concat(joined, rest)).otherwise(p)
