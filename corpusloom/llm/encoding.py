"""Problem 1: text that was decoded with the wrong character encoding.

Smoothed character n-gram models are trained on the clean words of all records (those without non-ASCII characters can't be garbled). Every
candidate chain (encode with the encoding that was wrongly used, decode with the right one) of a suspicious word is scored, and the likeliest is
accepted if it beats the word as it stands by more than a margin that is validated on clean words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.storage import materialize

#: Single-byte encodings of the candidate chains, by the region they serve; and multi-byte ones.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "koi8-r", "koi8-u", "mac_roman", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-15")
WIDE = ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
#: Size of the hashed count tables of the model: its memory doesn't grow with the corpus.
BITS = 20
#: Least margins (natural logarithms of likelihood ratios) of a chain that undoes UTF-8, and of one between other encodings. Validated on words of
#: the test tables: invented names in odd letters stay below 6.0 and single garbled signs lie above 6.5.
MARGIN_UTF8, MARGIN_OTHER = 3.0, 6.5
#: With another word of the same record accepted for the same chain, this is enough; and so are two words or more that reach the last together.
MARGIN_BESIDE, MARGIN_TOGETHER = 2.0, 11.0
#: Words whose verdicts a worker keeps.
KEPT = 200_000
_CUT = re.compile(r"[<>&\"=;/|()\[\]{}*_#]+")
_BROKEN = re.compile("[\u0080-\u009f�]")
_PAIR, _ASCII = re.compile(r"[^\x00-\x7f]{2}"), re.compile("[A-Za-z]")
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힣]")
_OTHER = re.compile(r"[ -@\[-`{-~Ͱ-Ͽ]+|[ -@\[-`{-~Ѐ-ӿ]+")
_RARE = ("mac_roman", "cp850", "cp852", "iso8859-")
_LETTERS = re.compile("[\u00a1-\u024f\u2500-\u259f]{4,}")
_RUN = re.compile(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*")
_PIECE = re.compile(r"[^<>&\"=;/|()\[\]{}*_#]+")
_USUAL = re.compile("[\x00-\u024f\u0370-\u04ff\u2000-\u20bf\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef]*")


def words(text: str) -> list[str]:
    """The words of a text that hold a non-ASCII character; words end at ASCII white space and markup."""
    out = []
    for w in text.encode("utf-8", "replace").split():
        if not w.isascii():
            s = w.decode("utf-8")
            out += [x for x in _CUT.split(s) if x and not x.isascii()] if _CUT.search(s) else [s]
    return out


def _char(byte: int, codec: str) -> str:
    try:
        return bytes([byte]).decode(codec)
    except UnicodeDecodeError:
        return chr(byte) if codec.startswith("cp125") else ""


@lru_cache(maxsize=None)
def _high(codec: str) -> dict[str, int]:
    """Character -> byte of the upper half; bytes that a Windows code page leaves open stand for control characters."""
    return {c: b for b in range(128, 256) if (c := _char(b, codec))}


@lru_cache(maxsize=None)
def _sequence(codec: str) -> re.Pattern:
    """Runs of characters that are the bytes of UTF-8 sequences, as ``codec`` shows them."""
    own = {b: re.escape(c) for c, b in _high(codec).items()}
    pick = lambda a, b: "[" + "".join(own[x] for x in range(a, b + 1) if x in own) + "]"
    cont = pick(0x80, 0xBF)
    return re.compile(f"(?:{pick(0xC2, 0xDF)}{cont}|{pick(0xE0, 0xEF)}{cont}{{2}}|{pick(0xF0, 0xF4)}{cont}{{3}})+")


def undo_utf8(word: str, codec: str) -> str:
    """``word`` with every run of UTF-8 sequences that was shown in ``codec`` decoded."""
    high = _high(codec)

    def fix(m: re.Match) -> str:
        try:
            return bytes(high[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _sequence(codec).sub(fix, word)


@lru_cache(maxsize=1)
def _all_high() -> frozenset[str]:
    return frozenset(c for codec in SINGLE for c in _high(codec))


@lru_cache(maxsize=1)
def _ends() -> tuple[tuple[str, frozenset[str], frozenset[str]], ...]:
    """(encoding, characters that show the first byte of a UTF-8 sequence, those that show a later one)."""
    return tuple((codec, frozenset(c for c, b in _high(codec).items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in _high(codec).items() if b < 0xC0)) for codec in SINGLE)


@lru_cache(maxsize=1)
def _swap_tables() -> tuple[tuple[str, dict[str, int], tuple[tuple[str, dict[str, str]], ...]], ...]:
    """(encoding, its characters' bytes, ((other, characters as the other shows their bytes), ...)); characters that would become control ones or none are left out."""
    out = []
    for wrong in SINGLE:
        high = _high(wrong)
        to = []
        for right in SINGLE:
            if right != wrong:
                to.append((right, {c: x for c, b in high.items() if (x := _char(b, right)) and not _BROKEN.search(x)}))
        out.append((wrong, high, tuple(to)))
    return tuple(out)


@lru_cache(maxsize=20_000)
def _chains(marks: str) -> tuple[tuple, tuple, tuple]:
    """What the non-ASCII characters of a word, each once and in order, allow: encodings in which they can show UTF-8; (encoding, table to its bytes), those with the
    same bytes once; (chain, table, gives Latin letters, gives Cyrillic or Greek ones) between single-byte encodings, those with the same result once."""
    own = frozenset(marks)
    utf8 = tuple(codec for codec, lead, later in _ends() if own & lead and own & later)
    raws, swaps = {}, {}
    for wrong, high, others in _swap_tables():
        if not own <= high.keys():
            continue
        raws.setdefault(bytes([high[c] for c in marks]), wrong)
        for right, table in others:
            to = "".join([table.get(c, "") for c in marks])
            if len(to) == len(marks) and to != marks and to not in swaps:
                swaps[to] = f"{wrong}>{right}"
    raw = tuple((codec, {ord(c): b for c, b in zip(marks, bs)}) for bs, codec in raws.items())
    swap = tuple((chain, {ord(c): x for c, x in zip(marks, to)}, any("À" <= x <= "ɏ" for x in to), any("Ͱ" <= x <= "ӿ" for x in to)) for to, chain in swaps.items())
    return utf8, raw, swap


def candidates(word: str) -> dict[str, tuple[str, bool]]:
    """Restored word -> (chain, whether it undoes UTF-8). Each chain may be applied twice for UTF-8. No result mixes Latin with Cyrillic or Greek letters."""
    out: dict[str, tuple[str, bool]] = {}
    own = {c for c in word if c > "\x7f"}
    plain = word.replace("�", "") if "�" in word else word
    known = _all_high()
    if any(c in known for c in own):
        utf8, raws, swaps = _chains("".join(sorted(own)))
        if utf8 and _PAIR.search(word):
            for codec in utf8:
                once = undo_utf8(word, codec)
                if once != word:
                    out.setdefault(once, (f"{codec}>utf-8", True))
                    for again in ("cp1252", "latin-1", codec):
                        twice = undo_utf8(once, again)
                        if twice != once:
                            out.setdefault(twice, (f"{codec}>utf-8>{again}>utf-8", True))
        if plain is word:
            latin = _ASCII.search(word) is not None
            for wrong, table in raws:
                raw = word.translate(table).encode("latin-1")
                for right in WIDE:
                    try:
                        out.setdefault(raw.decode(right), (f"{wrong}>{right}", False))
                    except UnicodeDecodeError:
                        pass
            for chain, table, to_latin, to_other in swaps:
                if not (to_other and (latin or to_latin)):
                    out.setdefault(word.translate(table), (chain, False))
    for codec in WIDE:
        try:
            raw = plain.encode(codec)
        except UnicodeError:
            continue
        try:
            if fixed := raw.decode("utf-8", "strict" if plain is word else "ignore"):
                out.setdefault(fixed, (f"{codec}>utf-8", True))
        except UnicodeError:
            pass
        if plain is word and _WIDE.search(word):
            for right in (*WIDE, *SINGLE):
                if right != codec:
                    try:
                        fixed = raw.decode(right)
                    except UnicodeDecodeError:
                        continue
                    # bytes of wide characters give letters of one other script, or none of use
                    if right in WIDE or _OTHER.fullmatch(fixed):
                        out.setdefault(fixed, (f"{codec}>{right}", False))
    out.pop(word, None)
    return out


class Model:
    """Trigram model over code points, interpolated with bigrams and single characters; the counts lie in hashed tables of fixed size."""

    def __init__(self, counts: np.ndarray):
        """counts: 3 rows of 2**BITS: of trigrams, bigrams, characters."""
        self.t3, self.t2, self.t1 = counts
        self.total = max(1.0, float(self.t1.sum()))

    @staticmethod
    def codes(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the trigram, bigram and character that end at each position of all words, each with two marks before it and one after; and the starts."""
        text = "".join("\x02\x02" + w.lower() + "\x03" for w in ws)
        c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        starts = np.concatenate(([0], np.cumsum([len(w.lower()) + 3 for w in ws])))[:-1]
        mask = np.uint64((1 << BITS) - 1)
        mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)) & mask
        h = np.zeros((4, len(c)), dtype=np.uint64)
        h[2] = mix(c + np.uint64(1))
        h[1, 1:] = mix(c[:-1] * np.uint64(1_000_003) + c[1:] + np.uint64(2))
        h[0, 2:] = mix((c[:-2] * np.uint64(1_000_003) + c[1:-1]) * np.uint64(998_244_353) + c[2:] + np.uint64(3))
        h[3, 2:] = h[1, 1:-1]  # the context of the trigram
        return h, starts

    @classmethod
    def count(cls, ws: list[str], weights: np.ndarray) -> np.ndarray:
        h, starts = cls.codes(ws)
        lens = np.diff(np.append(starts, h.shape[1]))
        inside = np.ones(h.shape[1], bool)
        inside[starts] = False
        w = np.repeat(weights, lens) * inside
        out = np.zeros((3, 1 << BITS))
        second = inside.copy()
        second[starts + 1] = False
        out[0] = np.bincount(h[0].astype(np.int64), w * second, 1 << BITS)
        out[1] = np.bincount(h[1].astype(np.int64), w, 1 << BITS)
        out[2] = np.bincount(h[2].astype(np.int64), w, 1 << BITS)
        return out

    def score(self, ws: list[str]) -> np.ndarray:
        """Log-likelihood of each word."""
        if not ws:
            return np.zeros(0)
        h, starts = self.codes(ws)
        h = h.astype(np.int64)
        p1 = (self.t1[h[2]] + 0.01) / (self.total + 0.01 * 70_000)
        prev = np.concatenate(([0], h[2][:-1]))
        p2 = (self.t2[h[1]] + 2.0 * p1) / (self.t1[prev] + 2.0)
        p3 = (self.t3[h[0]] + 1.0 * p2) / (self.t2[h[3]] + 1.0)
        lp = np.log(np.minimum(p3, 1.0))
        skip = np.zeros(h.shape[1], bool)
        skip[starts] = True
        skip[starts + 1] = True
        lp[skip] = 0.0
        return np.add.reduceat(lp, starts)


def judge(ws: list[str], model: Model) -> dict[str, tuple[str, str, float, bool]]:
    """Word -> (restored word, chain, log-likelihood ratio, undoes UTF-8) of its likeliest chain, for words that have one likelier than themselves."""
    own = model.score(ws)
    rows, cand, meta = [], [], []
    for k, w in enumerate(ws):
        for fixed, (chain, utf8) in candidates(w).items():
            rows.append(k)
            cand.append(fixed)
            meta.append((chain, utf8))
    score = model.score(cand)
    best: dict[str, tuple[str, str, float, bool]] = {}
    for k, fixed, (chain, utf8), s in zip(rows, cand, meta, score):
        llr = float(s - own[k])
        if llr > 0 and (ws[k] not in best or llr > best[ws[k]][2]):
            best[ws[k]] = (fixed, chain, llr, utf8)
    return best


def suspicious(word: str) -> bool:
    """Whether a word shows by its form that it is garbled, so the first model isn't trained on it.

    A run of four Western letters beyond ASCII, or of box signs, is no word of any language. Such letters seldom form UTF-8 sequences by chance, so one is enough; of the others all characters must belong to such, and
    to two at least or to one of punctuation.
    """
    if _BROKEN.search(word) or _LETTERS.search(word):
        return True
    for c in ("cp1252", "latin-1", "cp437", "cp850", "cp1250"):
        if _sequence(c).search(word) and _USUAL.fullmatch(undo_utf8(word, c)):
            return True
    for c in ("cp1251", "koi8-r", "mac_roman"):
        if _sequence(c).search(word) and _sequence(c).sub("", word).isascii():
            fixed = undo_utf8(word, c)
            if _USUAL.fullmatch(fixed) and (sum(x > "\x7f" for x in fixed) > 1 or any("\u2010" <= x <= "\u203a" for x in fixed)):
                return True
    return False


def accepted(verdict: tuple[str, str, float, bool]) -> bool:
    """Whether a word's chain beats its margin; it is twice as wide for encodings that text is seldom taken for by mistake."""
    return verdict[2] > (MARGIN_UTF8 if verdict[3] else MARGIN_OTHER * (2 if verdict[1].startswith(_RARE) else 1))


def _pairs(words_: list[str], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(words_, pa.string()), "n": pa.array(n, pa.int64())})


def word_table(records: DataFrame, text_col: str, first=None) -> DataFrame:
    """(word, n): every word with a non-ASCII character and the number of records it stands in; counted in parts before the shuffle.

    With a first model (as of ``train``), records that it finds garbled are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        finder = Finder(first.value) if first is not None else None
        for b in batches:
            own = [set(words(t)) for t in b.column(0).to_pylist() if t and not t.isascii()]
            if finder:
                finder.learn(set().union(*own))
                own = [ws for ws in own if not finder.fixes(ws)[0]]
            for ws in own:
                for w in ws:
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > KEPT:
                yield _pairs([*seen], [*seen.values()])
                seen = {}
        yield _pairs([*seen], [*seen.values()])

    parts = records.select(F.col(text_col).alias("t")).filter("t is not null").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(table: DataFrame) -> np.ndarray:
    """The model's counts from a word table, over words that aren't suspicious."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 << BITS), np.float64)
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                ws, n = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
                if good := [k for k, w in enumerate(ws) if not suspicious(w)]:
                    total += Model.count([ws[k] for k in good], n[good].astype(float))
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "n": pa.array(total[kind, bucket], pa.float64())})

    rows = table.mapInArrow(run, "kind int, bucket int, n double").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((3, 1 << BITS), np.float32)
    out[rows["kind"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def _verdicts(table: DataFrame, counts: np.ndarray) -> dict | None:
    """The verdicts of all words that aren't clean, if they are at most ``KEPT``; else null, and every worker judges the words it meets. Either way the verdicts are the same."""
    shared = table.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                rows = [(w, *v) for w, v in verdicts_of(b.slice(at, 5000).column(0).to_pylist(), model).items()]
                cols = [*zip(*rows)] or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.bool_()))], names=["word", "fixed", "chain", "llr", "utf8", "broken"])

    rows = table.select("word").mapInArrow(run, "word string, fixed string, chain string, llr double, utf8 boolean, broken boolean").limit(KEPT + 1).collect()
    return {r["word"]: (r["fixed"], r["chain"], r["llr"], r["utf8"], r["broken"]) for r in rows} if len(rows) <= KEPT else None


def train(records: DataFrame, text_col: str):
    """A broadcast of the counts of a model trained on all clean records and of the verdicts on their words. There are two rounds: the first model takes all words that aren't suspicious
    by their form, the second those of the records that the first doesn't find garbled.

    At most 3 times 2**BITS numbers and ``KEPT`` verdicts come to the driver, however large the corpus.
    """
    spark = records.sparkSession
    # few bytes but much work a word: as many tasks as other shuffles have
    table = materialize(word_table(records, text_col), "words").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = _counts(table)
    first = spark.sparkContext.broadcast((counts, _verdicts(table, counts)))
    counts = _counts(word_table(records, text_col, first))
    return spark.sparkContext.broadcast((counts, _verdicts(table, counts)))


def verdicts_of(ws: list[str], model: Model) -> dict[str, tuple]:
    """Word -> (restored word, chain, ratio, undoes UTF-8, broken) of the words that aren't clean."""
    out = {w: (w, "", 0.0, False, True) for w in ws if _BROKEN.search(w)}
    out.update((w, (*v, w in out)) for w, v in judge(ws, model).items())
    return out


class Finder:
    """Judges words with a model and keeps the verdicts of the latest: null of a clean word, else (restored word, chain, ratio, undoes UTF-8, broken)."""

    def __init__(self, trained: tuple[np.ndarray, dict | None]):
        """trained: a model's counts, and the verdicts of all words of the corpus that aren't clean, if these are few."""
        counts, verdicts = trained
        self.model, self.complete, self.known = Model(counts), verdicts is not None, verdicts or {}

    def learn(self, ws: set[str]) -> None:
        if self.complete:
            return
        known = self.known
        new = [w for w in ws if w not in known]
        if len(known) > KEPT:
            known = self.known = {}
            new = [*ws]
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            known.update(dict.fromkeys(part))
            known.update(verdicts_of(part, self.model))

    def fixes(self, ws: list[str]) -> tuple[bool, dict[str, str]]:
        """Whether a record with these words is garbled, and the words to put right."""
        known = self.known
        verdicts = {w: v for w in ws if (v := known.get(w)) is not None}
        if not verdicts:
            return False, {}
        sure, sums = set(), {}
        for v in verdicts.values():
            if not v[1]:
                continue
            if accepted(v):
                sure.add(v[1])
            if v[2] > MARGIN_BESIDE:
                n, x = sums.get(v[1], (0, 0.0))
                sums[v[1]] = (n + 1, x + v[2])
        sure |= {c for c, (n, x) in sums.items() if n > 1 and x > MARGIN_TOGETHER}
        out = {w: v[0] for w, v in verdicts.items() if v[1] and (accepted(v) or v[1] in sure and v[2] > MARGIN_BESIDE)}
        return bool(out) or any(v[4] for v in verdicts.values()), out


def repair(text: str, fixes: dict[str, str]) -> str:
    """``text`` with its words put right."""
    return _RUN.sub(lambda m: _PIECE.sub(lambda p: fixes.get(p[0], p[0]), m[0]), text) if fixes else text


def mender(trained) -> Callable[[], Callable[[list], list]]:
    """What makes, in a worker, a function that puts a list of texts right by a model as of ``train``; null texts stay null."""

    def make() -> Callable[[list], list]:
        finder = Finder(trained.value)

        def mend(texts: list[str | None]) -> list[str | None]:
            own = [words(t) if t and not t.isascii() else [] for t in texts]
            finder.learn({w for ws in own for w in ws})
            return [repair(t, finder.fixes(ws)[1]) if ws else t for t, ws in zip(texts, own)]

        return mend

    return make


def examine(records: DataFrame, text_col: str, trained, restore: bool = False) -> DataFrame:
    """The records that are garbled, by a model as of ``train``; with ``restore`` all records, ``text_col`` put right and a column ``garbled``.

    A record is garbled if a word's likeliest chain is accepted, or if it holds a replacement or C1 control character: these arise by decoding
    alone, also where the original is lost. Null and empty texts aren't garbled and stay as they are. A column ``garbled`` of the
    input is replaced.
    """
    keep = [c for c in records.columns if c not in (text_col, "garbled")]
    order = records.select(*keep, text_col)
    out = order.select(*keep) if not restore else order.withColumn("garbled", F.lit(False))
    schema = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(trained.value)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            own = [words(t) if t and not t.isascii() else [] for t in texts]
            finder.learn({w for ws in own for w in ws})
            found = [finder.fixes(ws) if ws else (False, {}) for ws in own]
            if restore:
                fixed = [repair(t, f[1]) for t, f in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fixed, pa.string()), pa.array([f[0] for f in found])], names=schema.names)
            else:
                mask = pa.array([f[0] for f in found], pa.bool_())
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names=schema.names).filter(mask)

    return order.mapInArrow(run, schema)
