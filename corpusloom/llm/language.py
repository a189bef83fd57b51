"""Problem 3: missing or wrong language labels.

Compression classification: each line is compressed with one zstandard raw-content dictionary per language, and the language with the smallest result is chosen; where
the next is nearly as small, the line is left to the language of its text. The language of a text is that of most of its letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "uk", "sv", "tr", "el", "ja", "zh")
#: Three-letter codes and names of the languages, in English and their own.
NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano castilian",
    "pt": "por portuguese português portugues", "it": "ita italian italiano", "nl": "nld dut dutch nederlands flemish", "pl": "pol polish polski",
    "ru": "rus russian русский", "uk": "ukr ukrainian українська", "sv": "swe swedish svenska", "tr": "tur turkish türkçe turkce",
    "el": "ell gre greek ελληνικά", "ja": "jpn japanese 日本語", "zh": "zho chi chinese 中文",
}
#: A few sentences of each language, for those of which a table has too few labelled lines.
SEEDS = {
    "en": "the people of the town have been here since the beginning and they will not leave, because there is nothing which would make them happier than this. what did you say about that, and where were those other things when we came to see them?",
    "de": "die leute in der stadt sind seit dem anfang hier und werden nicht gehen, weil es nichts gibt, was sie glücklicher machen würde als das. was haben sie darüber gesagt, und wo waren die anderen dinge, als wir kamen, um sie zu sehen?",
    "fr": "les gens de la ville sont ici depuis le début et ne partiront pas, parce qu’il n’y a rien qui les rendrait plus heureux que cela. qu’avez-vous dit à ce sujet, et où étaient les autres choses quand nous sommes venus les voir ?",
    "es": "la gente de la ciudad está aquí desde el principio y no se irá, porque no hay nada que les haga más felices que esto. ¿qué dijo usted sobre eso, y dónde estaban las otras cosas cuando vinimos a verlas?",
    "pt": "as pessoas da cidade estão aqui desde o começo e não vão embora, porque não há nada que as faça mais felizes do que isto. o que disse você sobre isso, e onde estavam as outras coisas quando viemos vê-las?",
    "it": "la gente della città è qui fin dall’inizio e non se ne andrà, perché non c’è niente che la renderebbe più felice di questo. che cosa ha detto di ciò, e dove erano le altre cose quando siamo venuti a vederle?",
    "nl": "de mensen van de stad zijn hier vanaf het begin en zullen niet weggaan, omdat er niets is dat hen gelukkiger zou maken dan dit. wat hebt u daarover gezegd, en waar waren de andere dingen toen wij kwamen om ze te zien?",
    "pl": "ludzie z miasta są tutaj od początku i nie odejdą, ponieważ nie ma niczego, co uczyniłoby ich szczęśliwszymi niż to. co pan o tym powiedział i gdzie były inne rzeczy, kiedy przyszliśmy je zobaczyć?",
    "ru": "люди города живут здесь с самого начала и не уйдут, потому что нет ничего, что сделало бы их счастливее, чем это. что вы сказали об этом, и где были другие вещи, когда мы пришли их посмотреть?",
    "uk": "люди міста живуть тут від самого початку і не підуть, бо немає нічого, що зробило б їх щасливішими, ніж це. що ви сказали про це, і де були інші речі, коли ми прийшли їх подивитися?",
    "sv": "människorna i staden har varit här sedan början och kommer inte att gå, eftersom det inte finns något som skulle göra dem lyckligare än det här. vad sade ni om det, och var fanns de andra sakerna när vi kom för att se dem?",
    "tr": "şehrin insanları başından beri burada ve gitmeyecekler, çünkü onları bundan daha mutlu edecek hiçbir şey yok. bunun hakkında ne söylediniz ve biz onları görmeye geldiğimizde diğer şeyler neredeydi?",
    "el": "οι άνθρωποι της πόλης είναι εδώ από την αρχή και δεν θα φύγουν, γιατί δεν υπάρχει τίποτα που θα τους έκανε πιο ευτυχισμένους από αυτό. τι είπατε για αυτό, και πού ήταν τα άλλα πράγματα όταν ήρθαμε να τα δούμε;",
    "ja": "町の人々は最初からここにいて、これ以上幸せにしてくれるものはないので、離れることはありません。それについて何と言いましたか、そして私たちが見に来たとき、ほかの物はどこにありましたか。",
    "zh": "城里的人从一开始就在这里，他们不会离开，因为没有什么能让他们比现在更幸福。关于这件事您说了什么？我们来看的时候，别的东西在哪里？",
}
#: Texts per label in the sample that the dictionaries are made of, and bytes of a dictionary.
SAMPLE, DICTIONARY = 200, 80_000
#: Characters of one of them.
EXCERPT = 20_000
#: Parameters of compression: a table with room for every place of a dictionary, short matches, and literals left as they are (by the target length), so the size tells what the
#: dictionary holds and not how evenly letters are spread. On lines of labelled texts this is right as often as level 1, at half the time.
PARAMETERS = {"window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 1, "min_match": 5, "target_length": 1, "strategy": 1}
#: A line is rejected if the next language's size is larger by less than this share, or by fewer bytes.
NARROW, NARROW_BYTES = 0.05, 3
#: Lines of fewer letters are left to their text, unless nothing else is there.
SHORT, LONG = 12, 40
#: Characters that are taken together in one pass of a worker, and lines whose languages it keeps.
TOGETHER, KEPT = 1_000_000, 100_000
_LATIN = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "sv", "tr")
#: The languages whose dictionaries a line is compressed under, by its script: all that are written in it, and beside a few of those one or more of every other script.
_CANDIDATES = {1: _LATIN, 2: ("el", "en", "ru", "ja"), 3: ("ru", "uk", "el", "en"), 4: ("ja", "zh", "en", "ru"), 5: ("zh", "ja", "en", "ru")}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Script of each code point below 65,536: 0 no letter, 1 Latin, 2 Greek, 3 Cyrillic, 4 kana, 5 Han, 6 other."""
    out = np.zeros(65536, np.uint8)
    for c in range(65536):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L":
            out[c] = 1 if c < 0x250 or 0x1E00 <= c < 0x1F00 else 2 if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else 3 if 0x400 <= c < 0x530 else 4 if 0x3040 <= c < 0x3100 or 0xFF66 <= c < 0xFF9E else 5 if 0x3400 <= c < 0xA000 or c in (0x3005, 0x3006) or 0xF900 <= c < 0xFB00 else 6
    return out


def label_language(label: str | None) -> str | None:
    """The two-letter code that a label names in any spelling, or null."""
    if not label:
        return None
    s = label.strip().lower()
    for part in (s, re.split(r"[-_ ]", s)[0]):
        if part in LANGUAGES:
            return part
        for code, names in NAMES.items():
            if part in names.split():
                return code
    return None


def label_column(column):
    """``label_language`` as a column expression: a lookup in the fixed table."""
    pairs = [(x, code) for code in LANGUAGES for x in (code, *NAMES[code].split())]
    table = F.create_map(*[F.lit(v) for p in pairs for v in p])
    s = F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))
    return F.coalesce(F.try_element_at(table, s), F.try_element_at(table, F.element_at(F.split(s, "[-_ ]"), 1)))


def scripts_of(counts: np.ndarray) -> np.ndarray:
    """The script of most letters of each line, from letters by script; kana make a line Japanese, since Han letters stand in both."""
    cjk = counts[:, 3] + counts[:, 4]
    own = np.where(counts[:, 3] * 20 > cjk, 4, 5)
    return np.where(cjk > counts[:, :3].sum(axis=1), own, counts.argmax(axis=1) + 1)


def line_scripts(text: str) -> tuple[list[str], np.ndarray]:
    """The lines of a text, and for each the number of letters by script."""
    lines = text.split("\n")
    codes = np.frombuffer(text.encode("utf-16-le", "replace"), dtype=np.uint16)
    kinds = _classes()[codes] if len(codes) else np.zeros(0, np.uint8)
    row = np.cumsum(codes == 10) if len(codes) else np.zeros(0, np.int64)
    return lines, np.bincount(row * 7 + kinds, minlength=7 * len(lines)).reshape(-1, 7)[: len(lines), 1:]


class Classifier:
    """Sizes of lines under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        p = z.ZstdCompressionParameters(**PARAMETERS, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.compressors = {}
        for lang, raw in dictionaries.items():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.compressors[lang] = z.ZstdCompressor(compression_params=p, dict_data=d)
        self.known: dict[tuple[str, int], tuple[str, float]] = {}

    def lines(self, lines: list[tuple[str, int]]) -> list[tuple[str, float]]:
        """(language, confidence) of lines (line, script of most of its letters): the margin of the smallest size to the next, as a share of that.

        What a line gets depends on the line alone, so neither on the order of lines nor on tasks.
        """
        known = self.known
        new = dict.fromkeys(x for x in lines if x not in known)
        if len(known) + len(new) > KEPT:
            known = self.known = {}
            new = dict.fromkeys(lines)
        by: dict[int, list[tuple[str, int]]] = {}
        for x in new:
            by.setdefault(x[1], []).append(x)
        for script, own in by.items():
            langs = _CANDIDATES.get(script, ())
            data = [" ".join(x.lower().split()).encode("utf-8", "replace") for x, _ in own]
            full = [k for k, d in enumerate(data) if d]
            if not langs or not full:
                known.update(dict.fromkeys(own, ("", 0.0)))
                continue
            part = [data[k] for k in full]
            sizes = np.full((len(langs), len(own)), 8)
            for j, lang in enumerate(langs):
                sizes[j, full] = [len(c) for c in self.compressors[lang].multi_compress_to_buffer(part, threads=1)]
            sizes -= 8  # of the frame
            # of equal sizes the first code in the alphabet counts
            order = sorted(range(len(langs)), key=lambda j: langs[j])
            sizes = sizes[order]
            best = sizes.argmin(axis=0)
            two = np.partition(sizes, 1, axis=0)[:2]
            gap = two[1] - two[0]
            conf = np.where(gap >= NARROW_BYTES, gap / np.maximum(two[1], 1), 0.0).tolist()
            known.update(zip(own, zip((langs[order[j]] for j in best.tolist()), conf)))
        return [known[x] for x in lines]

    def line(self, line: str, script: int) -> tuple[str, float]:
        """``lines`` of one line."""
        return self.lines([(line, script)])[0]

    def texts(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, str, float, int]]]]:
        """``text`` of many texts, whose lines are compressed together."""
        out, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= TOGETHER:
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            lines, counts = line_scripts("\n".join(part))
            total, script = counts.sum(axis=1), scripts_of(counts)
            long = (total >= SHORT).nonzero()[0].tolist()
            got = dict(zip(long, self.lines([(lines[k], s) for k, s in zip(long, script[long].tolist())])))
            total, script, k = total.tolist(), script.tolist(), 0
            for t in part:
                n = t.count("\n") + 1
                out.append(self._vote(t, [(j - k + 1, total[j], script[j], got.get(j)) for j in range(k, k + n) if total[j]]))
                k += n
            at = end
        return out

    def text(self, text: str) -> tuple[str, float, list[tuple[int, str, float, int]]]:
        """(language, confidence, lines) of a text; lines: (number, language, confidence, letters) of each line with letters.

        A line with few letters or a narrow margin gets the text's language, with confidence 0.
        """
        return self.texts([text])[0]

    def _vote(self, text: str, lines: list[tuple]) -> tuple[str, float, list[tuple[int, str, float, int]]]:
        """``text`` from its lines with letters: (number, letters, script, (language, confidence) or null)."""
        votes: dict[str, int] = {}
        rows, loose = [], []
        for no, t, _, got in lines:
            lang, conf = got or ("", 0.0)
            if conf >= NARROW:
                votes[lang] = votes.get(lang, 0) + t
            else:
                if got:
                    loose.append((t, lang))
                lang, conf = "", 0.0
            rows.append((no, lang, conf, t))
        if not votes:
            for t, lang in loose:
                votes[lang] = votes.get(lang, 0) + t
        if not votes and lines:
            lang, _ = self.line(text, max(lines, key=lambda r: r[1])[2])
            votes[lang] = 1
        votes.pop("", None)
        if not votes:
            return "", 0.0, rows
        main = max(sorted(votes), key=lambda x: votes[x])
        conf = votes[main] / max(1, sum(r[3] for r in rows))
        return main, min(1.0, conf), [(no, lang or main, c, t) for no, lang, c, t in rows]


def build(sample: list[tuple[str, str]], size: int = DICTIONARY, totals: dict[str, int] | None = None) -> tuple[dict[str, bytes]]:
    """What a ``Classifier`` is made of, the dictionaries alone, from (language, text) pairs, whose labels are mostly right. ``totals``: the number of texts of each label that the pairs were drawn from.

    A line (its letters) that stands under several labels goes to the one where it is most frequent among all texts, by what the pairs of each label stand for: a site's own lines stand in texts of
    all languages, and in a larger share of those of rare ones, which are all in the sample. Then the
    lines are judged by dictionaries made of the other half of them, twice, and those that another language compresses
    better are dropped, unless they stand in three texts or more, mostly of one label: then they are known by that. Each dictionary begins with the language's own seed sentences.
    """
    drawn = Counter(lang for lang, _ in sample)
    weight = {x: max(1.0, (totals or drawn).get(x, 0) / n) for x, n in drawn.items()}
    script_of = dict.fromkeys(_LATIN, 1) | {"el": 2, "ru": 3, "uk": 3, "ja": 4, "zh": 5}
    seen: dict[str, dict[str, int]] = {}
    form: dict[str, str] = {}
    for lang, text in sample:
        lines, counts = line_scripts(text)
        for line, script, total in zip(lines, scripts_of(counts).tolist(), counts.sum(axis=1).tolist()):
            if total >= LONG and script == script_of[lang]:
                key = re.sub(r"[\W\d_]+", "", low := line.lower())
                form.setdefault(key, " ".join(low.split()))
                own = seen.setdefault(key, {})
                own[lang] = own.get(lang, 0) + 1
    pool: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    often, firm = {}, set()
    for key, own in seen.items():
        stands = {x: n * weight[x] for x, n in own.items()}
        top = max(sorted(own), key=lambda x: stands[x])
        pool[top].append(form[key])
        often[form[key]] = own[top]
        if own[top] >= 3 and stands[top] >= 0.6 * sum(stands.values()):
            firm.add(form[key])

    def pack(lines: list[str], lang: str) -> bytes:
        out, total = [], 0
        for x in lines:
            b = x.encode("utf-8", "replace")
            out.append(b)
            total += len(b) + 1
            if total > size:
                break
        return b"\n".join([SEEDS[lang].encode(), *out])

    for _ in range(2):
        kept: dict[str, list[str]] = {x: [] for x in LANGUAGES}
        for half in (0, 1):
            c = Classifier({x: pack(pool[x][half::2], x) for x in LANGUAGES})
            for x in LANGUAGES:
                own = pool[x][1 - half :: 2]
                kept[x] += [line for line, got in zip(own, c.lines([(line, script_of[x]) for line in own])) if line in firm or got[0] == x and got[1] >= NARROW]
        # neighbours of one text apart again
        pool = {x: sorted(v, key=hash_of) for x, v in kept.items()}
    out = {}
    for x in LANGUAGES:
        # what recurs comes first, in up to half of the room: short set phrases are else easily missed
        first, room = [], size // 2
        for line in sorted((line for line in pool[x] if often[line] > 2), key=lambda line: (-often[line], line)):
            if (room := room - len(line.encode())) < 0:
                break
            first.append(line)
        rest = set(first)
        out[x] = pack(first + [line for line in pool[x] if line not in rest], x)
    return (out,)


def hash_of(line: str) -> int:
    import zlib

    return zlib.crc32(line.encode("utf-8", "replace"))


def excerpt(text: str, size: int = EXCERPT) -> str:
    """A text of at most about ``size`` characters as it is, of a longer one lines from all over it: those of the smallest hash, in order."""
    if len(text) <= size:
        return text
    lines, picked, room = text.split("\n"), [], size
    for k in sorted(range(len(lines)), key=lambda k: (hash_of(lines[k]), k)):
        if (room := room - len(lines[k]) - 1) < 0:
            break
        picked.append(k)
    return "\n".join(lines[k] for k in sorted(picked)) if picked else text[:size]


def train(texts: DataFrame, id_col: str = "text_id", text_col: str = "extracted_text", label_col: str = "lang") -> tuple[dict[str, bytes]]:
    """Dictionaries, as of ``build``, from a bounded sample: of each label the ``SAMPLE`` texts of the smallest hash, of each an ``excerpt``. They and the number of texts of each label are all that comes to the driver."""
    t = texts.select(F.xxhash64(id_col).alias("h"), label_column(F.col(label_col)).alias("l"), F.col(text_col).alias("t")).filter("l is not null and t is not null")
    top = t.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h", F.xxhash64("t")))).filter(F.col("r") <= SAMPLE).select("l", "t", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([excerpt(x) for x in b.column(1).to_pylist()], pa.string()), b.column(2)], names=["l", "t", "h"])

    rows = top.mapInArrow(run, "l string, t string, h long").collect()
    totals = {r["l"]: r["n"] for r in t.groupBy("l").agg(F.count("*").alias("n")).collect()}
    return build([(r["l"], r["t"]) for r in sorted(rows, key=lambda r: (r["l"], r["h"], r["t"]))], totals=totals)


def classify(texts: DataFrame, trained: tuple[dict[str, bytes]], id_col: str = "text_id", text_col: str = "extracted_text", label_col: str = "lang", mend: Callable | None = None) -> DataFrame:
    """(id, line_no, lang, confidence, letters, label, main): a row for each text (line_no 0) and for each of its lines with letters.

    label: the language that the text's label names, or null; main: the language of the text. ``mend`` makes, in a worker, a function that puts a list of texts right before they are
    judged. Texts without letters of a known script have an empty lang and confidence 0, null texts no rows. Repeated rows come out repeatedly.
    """
    shared = texts.sparkSession.sparkContext.broadcast(trained)
    source = texts.select(F.col(id_col).cast("long").alias("id"), label_column(F.col(label_col)).alias("label"), F.col(text_col).alias("t")).filter("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(*shared.value)
        fix = mend() if mend else list
        for b in batches:
            at, no, lang, conf, letters, main = [], [], [], [], [], []
            for k, (own, sure, rows) in enumerate(c.texts(fix(b.column(2).to_pylist()))):
                rows = [(0, own, sure, sum(r[3] for r in rows)), *rows]
                at += [k] * len(rows)
                main += [own] * len(rows)
                a, x, y, z = zip(*rows)
                no += a
                lang += x
                conf += y
                letters += z
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_pydict({"id": b.column(0).take(at), "line_no": pa.array(no, pa.int32()), "lang": pa.array(lang, pa.string()), "confidence": pa.array(conf, pa.float64()), "letters": pa.array(letters, pa.int32()), "label": b.column(1).take(at), "main": pa.array(main, pa.string())})

    return source.mapInArrow(run, "id long, line_no int, lang string, confidence double, letters int, label string, main string")


def misfits(classified: DataFrame, least: int = LONG) -> DataFrame:
    """(id, line_no, lang): texts whose label is missing or wrong (line_no 0), and lines of at least ``least`` letters in another language than their text."""
    text = (F.col("line_no") == 0) & (F.col("lang") != "") & ~F.col("label").eqNullSafe(F.col("lang"))
    line = (F.col("line_no") > 0) & (F.col("letters") >= least) & (F.col("lang") != F.col("main")) & (F.col("lang") != "")
    return classified.filter(text | line).select("id", "line_no", "lang").distinct()


def segments(classified: DataFrame) -> DataFrame:
    """(id, first_line, last_line, lang, confidence, letters): stretches of lines of one language, the confidence weighted by letters; and each text, with lines 0."""
    lines = classified.filter("line_no > 0")
    w = W.partitionBy("id").orderBy("line_no")
    at = lines.withColumn("new", (~F.col("lang").eqNullSafe(F.lag("lang").over(w))).cast("int")).withColumn("seg", F.sum("new").over(w))
    out = at.groupBy("id", "seg", "lang").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"), F.sum("letters").cast("long").alias("letters"))
    whole = classified.filter("line_no = 0").select("id", F.lit(0).alias("first_line"), F.lit(0).alias("last_line"), "lang", "confidence", F.col("letters").cast("long").alias("letters"))
    return out.select(whole.columns).unionByName(whole)
