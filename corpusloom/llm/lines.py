"""A table of the lines of all pages and texts, with what the operators on templates and spam need to know of each.

A line is a line of a text or a block of a page. The table is narrow: hashes and counts, no text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from corpusloom.llm.html import blocks

#: Frequent function words by language; of Chinese and Japanese single characters.
FUNCTION_WORDS = {
    "en": "the a an of and to in is are was has have for on at by with its it that this from while but so which because although not you your we our",
    "de": "der die das den dem des ein eine einen und ist sind war hat im in zu zum zur von mit für auf an bei nach nicht sich wie was aber denn über unter sie ihr wir uns",
    "fr": "le la les l un une des du de d et est a sont au aux dans en pour par sur avec ne pas plus que qui ce cette son sa ses nous vous mais",
    "es": "el la los las un una de del y es ha han en para por con se su sus que no al lo como más este esta pero porque",
    "pt": "o a os as um uma de do da dos das e é foi em no na nos nas para por com se seu sua que não ao mais esta este mas porque",
    "it": "il lo la i gli le un una di del della dei delle e è ha hanno in nel per da con si suo sua che non al più questo questa ma perché l",
    "nl": "de het een van en is zijn heeft in op te voor met aan bij door niet zich dat die haar onze maar want naar over u uw wij ons",
    "pl": "i w na z do że się nie jest to po za od dla nad już co jak ale lub oraz przez pod jej nasz tę o ta ten",
    "ru": "и в на с по не что за из у к от до для но как это его её уже над под их мы вы наша о ещё или об",
    "uk": "і в на з по не що за із у до від для але як це його її вже над під та наша про ще або й",
    "sv": "och i på en ett den det de av för med att är som har inte till om sig vår hennes men över under vi ni från längre",
    "tr": "ve bir bu da de için ile çok daha ne artık hâlâ her en eski onun sonra kadar ama gibi olan",
    "el": "ο η το οι τα τον την του της των και είναι σε με για από που δεν να στο στη στον στην θα μια ένα ένας μας αλλά",
}
_CJK_FUNCTION = re.compile("[的了在是和有不这那一也被把从到与很就のはにをがでともへやからまですた]")
_FUNCTION = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws.split())
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_VARIES = re.compile(r"[0-9/\[]")
_DIGIT = re.compile(r"[0-9]")
#: Bytes of UTF-8 with spaces for the ASCII signs that aren't letters.
_NO_LETTERS = bytes(k if k > 127 or chr(k).isalpha() else 32 for k in range(256))
#: The most frequent other signs that part words.
_SIGNS = "’–…“”„«»—·©。，、"
#: What parts the entries of a list; filler that repeats a word has none.
_LISTED = re.compile(r"[,;|]")
_KANA = re.compile("[぀-ヿ]")
_MAYBE_HOST = re.compile(r"[.#]\w")
_HOST = re.compile(r"\b[\w-]+(?:\.[\w-]+)+(?:/\S*)?|https?://\S+|#\w+")
#: Forms of an unfilled slot: a short name in any of the brackets that template languages use.
_NAME = r"[ \t]*[^\W\d_][\w .-]{0,28}[ \t]*|[ \t]*\d{1,3}[ \t]*"
SLOT = re.compile(
    rf"\{{\{{\{{?(?:{_NAME})\}}\}}\}}?|[$#]\{{(?:{_NAME})\}}|\{{(?:{_NAME})\}}|\[\[(?:{_NAME})\]\]|\[(?:{_NAME})\]|<<(?:{_NAME})>>|<%=?(?:{_NAME})%>|<(?:{_NAME})>|%%(?:{_NAME})%%|%\((?:{_NAME})\)s|(?<!\w)__(?:{_NAME})__(?!\w)|"
    rf"(?<!\w)\$(?:{_NAME})\$(?!\w)|(?<!\w)@(?:{_NAME})@(?!\w)|(?<!\w)\?(?:{_NAME})\?(?!\w)|(?<!\w)&lt;(?:{_NAME})&gt;"
)
_BRACKET = re.compile(r"[{}\[\]<>%_$@&]|\?\w")
#: With which all of these begin; alone it is found much faster.
_BRACKET_START = re.compile(r"[{}\[\]<>%_$@&?]")
LANGS = (*FUNCTION_WORDS, "ja", "zh")
_LANGS_OF: dict[str, list[int]] = {}
for _k, _ws in enumerate(FUNCTION_WORDS.values()):
    for _w in _ws.split():
        _LANGS_OF.setdefault(_w, []).append(_k)
#: Words of the classic filler passage; two of them on a line make the rest of it filler vocabulary.
FILLER_SEEDS = frozenset("lorem ipsum dolor amet consectetur adipiscing elit tempor incididunt labore aliqua".split())
#: Words of a window.
WINDOW = 100
_COUNT = itemgetter(1)
#: n log n of the counts that a window may hold.
_N_LOG_N = [0.0, *[n * log2(n) for n in range(1, 2 * WINDOW)]]
#: Lines whose facts a worker keeps, and records that it takes at once: they bound its memory.
KEPT, SLICE = 50_000, 500
#: Of the site and the url only hashes are kept: they tell lines' places apart, and no more is asked of them.
SCHEMA = "kind string, id long, site long, url long, no int, key long, masked long, letters int, words int, func int, recur int, links int, cls int, sent int"


def letter_runs(low: str) -> list[str]:
    """The runs of letters of a line in lower case, as ``_WORD`` finds them: what is letters alone needn't be searched, which is slow."""
    if low.isascii():
        return low.encode().translate(_NO_LETTERS).decode().split()
    spaced = low.encode("utf-8", "surrogatepass").translate(_NO_LETTERS).decode("utf-8", "surrogatepass")
    runs = spaced.split()
    if "".join(runs).isalpha():
        return runs
    for sign in _SIGNS:
        spaced = spaced.replace(sign, " ")
    out = []
    for x in spaced.split():
        if x.isalpha():
            out.append(x)
        else:
            out += _WORD.findall(x)
    return out


def fixed_part(low: str) -> str:
    """A line in lower case without what varies between uses of one template, between white space: paths, what stands in brackets, and whatever has a digit."""
    return " ".join([x for x in low.split() if x.isalpha() or not (x[0] == "/" or x[0] == "[" and x[-1] == "]" or _DIGIT.search(x))])


def tokens(line: str) -> list[str]:
    """The words of a line in lower case; runs of Chinese or Japanese characters as pairs."""
    low = line.lower()
    if low.isascii() or not _CJK.search(low):
        return _WORD.findall(low)
    out = []
    for w in _WORD.findall(low):
        if len(w) > 1 and _CJK.match(w[0]):
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def hash64(s: str) -> int:
    """A hash of 64 bits, signed."""
    h = xxh3_64_intdigest(s.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def mask(low: str, host: str, runs: list[str] | None = None) -> str:
    """A line in lower case without what varies between uses of one template: numbers, codes, paths and the site's own name. ``runs``: its words, if known."""
    if runs is None or _VARIES.search(low):
        runs = letter_runs(fixed_part(low))
    return " ".join([w for w in runs if len(w) < 4 or w not in host])


def slot_share(line: str) -> float:
    """Share of a line's letters and digits that stand in unfilled slots."""
    if not _BRACKET_START.search(line) or not _BRACKET.search(line):
        return 0.0
    held = sum(len(m[0]) for m in SLOT.finditer(line))
    if not held:
        return 0.0
    return held / max(1, held + sum(map(str.isalnum, SLOT.sub("", line))))


def lines_of(kind: str, body: str | None) -> list[tuple[int, str, int]]:
    """(number, text, characters within links) of the lines of a record that aren't blank."""
    if not body:
        return []
    if kind == "page":
        return [(k + 1, b.text, b.links) for k, b in enumerate(blocks(body, around=False))]
    return [(k, y, sum(len(m[0]) for m in _HOST.finditer(x)) if _MAYBE_HOST.search(x) else 0) for k, x in enumerate(body.split("\n"), 1) if (y := x.strip())]


def line_facts(x: str, host: str, filler: frozenset, cues) -> tuple:
    """What depends on a line alone: (words joined by spaces, key, masked, letters, function words, cls, sent, CJK characters, number of words)."""
    low = x.lower()
    runs = letter_runs(low)
    squeezed = "".join(runs)
    cjk = 0 if low.isascii() else len(_CJK.findall(low))
    if cjk:
        ws = [p for w in runs for p in ([w[i : i + 2] for i in range(len(w) - 1)] if len(w) > 1 and _CJK.match(w) else (w,))]
    else:
        ws = runs
    n, letters = len(ws), len(squeezed)
    func = len([w for w in ws if w in _FUNCTION]) + (len(_CJK_FUNCTION.findall(x)) if cjk * 2 > letters else 0)
    every = set(ws)
    own = len(every)
    cls = 0
    if slot_share(x) >= 0.35:
        cls = 1
    elif n >= 4 and (own <= 3 and n >= 4 * own and len(_LISTED.findall(x)) < 2 or not filler.isdisjoint(every) and len([w for w in ws if w in filler]) >= 0.8 * n):
        cls = 2
    elif cues(low):
        cls = 3
    elif letters > 3 and squeezed in host:
        cls = 5
    sent = int(n >= 5 and func >= 0.1 * n and own * 3 > min(n, WINDOW))
    return " ".join(ws), hash64(squeezed), hash64(mask(low, host, runs)), letters, func, cls, sent, cjk, n


def describe(kind: str, site: str, body: str | None, filler: frozenset, cues, known: dict | None = None) -> list[tuple]:
    """Rows of SCHEMA from ``no`` on, of one record. ``known`` keeps what depends on a line alone.

    The first has no 0 and is of the whole record, in thousandths: masked the share of its three most frequent words that aren't function words, func the
    share of distinct words and recur the entropy against the most possible, both the mean over windows of ``WINDOW`` words; sent its lines, cls its
    language as a place in ``LANGS``, by its function words. Of lines, cls: 1 slots left unfilled, 2 filler, 3 a message of an error or a demand, 5 the site's name,
    6 the heading of a list of links, 0 other. recur: words, other than function words, that the record has four times or more. sent: whether the line
    reads as a sentence.
    """
    rows = lines_of(kind, body)
    if not rows:
        return []
    known = {} if known is None else known
    host = re.sub(r"[\W\d_]+", "", site.lower())
    facts = []
    for _, x, _ in rows:
        if (f := known.get((site, x))) is None:
            f = line_facts(x, host, filler, cues)
            if len(x) < 400:
                if len(known) >= KEPT:
                    known.clear()
                known[(site, x)] = f
        facts.append(f)
    flow = " ".join([f[0] for f in facts]).split()
    every = Counter(flow)
    total = len(flow)
    votes = [0] * len(LANGS)
    for w, n in every.items():
        if w in _LANGS_OF:
            for k in _LANGS_OF[w]:
                votes[k] += n
    letters, cjk = sum([f[3] for f in facts]), sum([f[7] for f in facts])
    if cjk * 3 > letters:
        votes[LANGS.index("ja" if any(_KANA.search(x) for _, x, _ in rows) else "zh")] += total
    # windows, so that the figures don't depend on the length of the record; a short rest joins the last
    cuts = [*range(0, max(1, total - WINDOW // 2), WINDOW), total]
    ratios, entropies = [], []
    for a, b in zip(cuts, cuts[1:]):
        n = b - a
        if n > 1:
            own = Counter(flow[a:b]) if n < total else every
            ratios.append(len(own) / n)
            entropies.append((log2(n) - sum([_N_LOG_N[v] for v in own.values() if v > 1]) / n) / log2(n))
    mean = lambda v: int(1000 * sum(v) / len(v)) if v else 1000
    top, seen, often = 0, 0, set()
    for least in (4, 1):  # the most frequent first; of most records nothing below 4 is needed, so it isn't sorted
        if least == 4 or seen < 3:
            for w, n in sorted([x for x in every.items() if x[1] >= 4] if least == 4 else [x for x in every.items() if x[1] < 4], key=_COUNT, reverse=True):
                if w not in _FUNCTION:
                    if n >= 4:
                        often.add(w)
                    if seen < 3 and (len(w) > 2 or _CJK.match(w)):
                        top, seen = top + n, seen + 1
    top = top * 1000 // max(1, total)
    linked = [n >= 0.8 * len(x) and len(x) > 30 for _, x, n in rows[1:]] + [False] if kind == "page" else [False] * len(rows)
    out = [(0, 0, top, letters, total, mean(ratios), mean(entropies), sum([r[2] for r in rows]), max(range(len(votes)), key=votes.__getitem__), len(rows))]
    recur = [0, *accumulate(map(often.__contains__, flow))] if often else [0] * (total + 1)
    end = 0
    for (no, x, links), before_link, (_, key, masked, n, func, cls, sent, _, size) in zip(rows, linked, facts):
        if before_link and not links and len(x) < 60 and cls in (0, 5):
            cls = 6
        start, end = end, end + size
        out.append((no, key, masked, n, size, func, recur[end] - recur[start], links, cls, sent))
    return out


def record_lines(records: DataFrame, filler: frozenset = frozenset(), cues=lambda line: False) -> DataFrame:
    """The line table (``SCHEMA``) of records (record_kind, record_id, site, url, body). Records with a null body or only blank lines have no rows."""
    site = F.coalesce("site", F.lit(""))
    source = records.select("record_kind", F.col("record_id").cast("long"), F.xxhash64(site).alias("site"), F.xxhash64(F.coalesce("url", F.lit(""))).alias("url"), site.alias("name"), "body")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                kinds, sites, bodies = (part.column(j).to_pylist() for j in (0, 4, 5))
                at, rows = [], []
                for k, (kind, site, body) in enumerate(zip(kinds, sites, bodies)):
                    own = describe(kind, site, body, filler, cues, known)
                    at += [k] * len(own)
                    rows += own
                at = pa.array(at, pa.int32())
                cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate([pa.int32(), *types])]
                yield pa.RecordBatch.from_arrays([*[part.column(j).take(at) for j in range(4)], *cols], names=names)

    return source.mapInArrow(run, SCHEMA)


def filler_words(records: DataFrame, least: int = 3) -> frozenset:
    """Filler vocabulary: the words of the classic passage, and words of at least ``least`` lines that hold two words of the classic passage. Such lines are so like each other that their words are few; all of them come to the driver."""
    seeds = "|".join(sorted(FILLER_SEEDS))
    body = F.regexp_replace(F.col("body"), "<[^<>]*>", "\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.match_substring_regex(b.column(0), seeds, ignore_case=True))

    # few bodies hold any of the words, and this search is much faster than the one that looks for whole words
    near = records.select(F.col("body").cast("string").alias("body")).mapInArrow(run, "body string")
    hit = near.filter(F.col("body").rlike(rf"(?i)\b({seeds})\b")).select(F.explode(F.split(body, "\n")).alias("line"))
    words = hit.select(F.expr(r"array_distinct(regexp_extract_all(lower(line), '([\\p{L}]+)', 1))").alias("w"))
    two = words.filter(F.size(F.array_intersect("w", F.array(*[F.lit(s) for s in sorted(FILLER_SEEDS)]))) >= 2)
    rows = two.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("w").collect()
    return FILLER_SEEDS | {r["w"] for r in rows if r["w"] not in _FUNCTION}
