"""Problem 10: cut items over a size limit at natural boundaries.

Dynamic programming over the boundary positions of a text: the cost of a cut depends on its kind (blank line, line break, end of sentence, clause,
word), the cost of a piece on how far its size is from an even share. Pieces stay within the limit and consecutive ones overlap by
a given number of tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import VOCABULARY, counter, encoder, with_tokens

#: The penalty of a cut by its kind. A size imbalance of the whole limit costs 1.
CUT_COST = {"paragraph": 0.0, "line": 0.15, "sentence": 0.3, "clause": 0.8, "word": 1.5, "token": 4.0}
#: Places that are taken at once.
BLOCK = 128
_KINDS = [("paragraph", re.compile(r"\n[ \t\r]*\n\s*")), ("line", re.compile(r"\n")), ("sentence", re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*")), ("clause", re.compile(r"[,;:]\s+|[，、；：]")), ("word", re.compile(r"\s+"))]


def boundaries(text: str) -> dict[int, str]:
    """Character position -> kind of the best boundary that ends there; a space at its end goes with the word after it, as it does in tokens."""
    found: dict[int, str] = {}
    for kind, pattern in _KINDS:
        for m in pattern.finditer(text):
            end = m.end()
            found.setdefault(end - 1 if text[end - 1] == " " else end, kind)
    found.pop(0, None)
    found.pop(len(text), None)
    return found


def cut_points(offsets: list[int], ends: dict[int, str], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges [start, end) of the pieces.

    offsets: the character position where each token begins, and the length of the text at last. ends: as of boundaries. Every piece has
    at most ``limit`` tokens; each but the first begins exactly ``overlap`` tokens before the end of the one before it. Cuts lie at
    boundaries; a stretch of a whole step without any also gets cuts between words' tokens, at every sixteenth of a step.
    """
    n = len(offsets) - 1
    if n <= limit:
        return [(0, n)] if n else []
    step = limit - overlap
    place: dict[int, float] = {}
    for pos, kind in ends.items():
        i = bisect_left(offsets, pos)
        if 0 < i < n:
            cost = CUT_COST[kind] if offsets[i] == pos else CUT_COST["token"] if kind == "word" else CUT_COST[kind] + 0.1
            place[i] = min(cost, place.get(i, 9.0))
    cuts = dict(place)
    grid = max(1, step // 16)
    last = 0
    for i in [*sorted(cuts), n]:
        if i - last > step // 2:
            for j in range(last + grid, i, grid):
                cuts.setdefault(j, CUT_COST["token"])
        last = i
    points = sorted(i for i in cuts if overlap < i < n or i >= 1 and overlap == 0 and i < n)
    pieces = -(-(n - overlap) // step)
    even = (n - overlap) / pieces + overlap
    # the least cost of pieces that cover the tokens up to each point, over all boundaries
    own = np.array([cuts[i] for i in points] + [0.0])
    at = np.array([*points, n])
    back = _least(at, own, limit, overlap, even)
    out, k = [], len(at) - 1
    while k >= 0:
        j = int(back[k])
        out.append((int(at[j]) - overlap if j >= 0 else 0, int(at[k])))
        k = j
    return out[::-1]


def _least(at: np.ndarray, own: np.ndarray, limit: int, overlap: int, even: float) -> np.ndarray:
    """For each place ``at`` with its cost ``own``, the number of the cut before it in the cheapest division up to it, or -1 if it ends the first piece.

    Places are taken in blocks that are short against a piece. A cut before the block counts only if its cost alone isn't above what some cut gives for all of the block, so those
    left out can't be the best for any place. A cut within the block would make a piece of at most the block's length; if the size of such a piece might pay, the block is done place by place.
    Either way the result is that of trying every cut within a piece's length.
    """
    step = limit - overlap
    cost, back = np.full(len(at), np.inf), np.full(len(at), -1)
    first = np.searchsorted(at, at - step)
    alone = np.where(at <= limit, ((at - even) / limit) ** 2, np.inf)
    start = 0
    while start < len(at):
        end = min(start + BLOCK, int(np.searchsorted(at, at[start] + step // 8, "right")))
        lo, last = first[start], first[end - 1]
        e, best, j = at[start:end], alone[start:end].copy(), np.full(end - start, -1)
        if last < start:
            i = last + int((cost[last:start] + ((at[end - 1] - at[last:start] + overlap - even) / limit) ** 2).argmin())
            most = np.minimum(best, cost[i] + ((e - at[i] + overlap - even) / limit) ** 2).max()
            near = lo + (cost[lo:start] <= most).nonzero()[0]
            if len(near):
                c = cost[near] + ((e[:, None] - at[near] + overlap - even) / limit) ** 2
                c[near < first[start:end, None]] = np.inf
                i = c.argmin(axis=1)
                least = c[np.arange(end - start), i]
                j = np.where(least < best, near[i], j)
                best = np.minimum(least, best)
        # the least that a cut within the block could give: a piece of the block's length is nearest to an even share, unless it's longer
        short = even - overlap - float(at[end - 1] - at[start])
        before = np.minimum.accumulate(best + own[start:end])[:-1]
        if short > 0 and (before + (short / limit) ** 2 > best[1:] + 1e-9).all():
            cost[start:end], back[start:end] = own[start:end] + best, j
        else:
            for k in range(start, end):
                least, j = alone[k], -1
                if (lo := first[k]) < k:
                    c = cost[lo:k] + ((at[k] - at[lo:k] + overlap - even) / limit) ** 2
                    i = int(c.argmin())
                    if c[i] < least:
                        least, j = c[i], lo + i
                cost[k], back[k] = own[k] + least, j
        start = end
    return back


@lru_cache(maxsize=2)
def _shapes(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token: how many characters begin in it, and whether it begins inside one."""
    enc = encoder(vocabulary)
    begun, inside = np.zeros(enc.n_vocab, np.int64), np.zeros(enc.n_vocab, bool)
    for t in range(enc.n_vocab):
        try:
            b = enc.decode_single_token_bytes(t)
        except KeyError:
            continue
        begun[t] = sum((x & 0xC0) != 0x80 for x in b)
        inside[t] = (b[0] & 0xC0) == 0x80
    return begun, inside


def split_text(text: str, limit: int, overlap: int, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int, str]]:
    """(start token, end token, tokens, text) of each piece.

    Cut where a token ends inside a character, the piece's text has the whole character; then its size is counted again and stays within
    the limit, as one token is held back for it.
    """
    tokens = encoder(vocabulary).encode_ordinary(text)
    if len(tokens) <= limit:
        return [(0, len(tokens), len(tokens), text)] if text else []
    # character position of each token's first byte: bytes that go on a character don't count
    begun, inside = _shapes(vocabulary)
    ids = np.array(tokens)
    pos = np.concatenate(([0], np.cumsum(begun[ids])))[:-1]
    offsets = np.where(inside[ids], np.maximum(pos - 1, 0), pos).tolist()
    offsets.append(len(text))
    count, ends, hold = counter(vocabulary), boundaries(text), 0
    while True:
        out = [(a, b, text[offsets[a] : offsets[b]]) for a, b in cut_points(offsets, ends, limit - hold, overlap)]
        sizes = [count(t) for *_, t in out]
        if max(sizes) <= limit:
            return [(a, b, n, t) for (a, b, t), n in zip(out, sizes)]
        hold += max(sizes) - limit


def oversized(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of each document with more than ``limit`` tokens. Texts of at most ``limit`` bytes can't be such and aren't encoded."""
    return with_tokens(docs.select(id_col, text_col).filter(F.octet_length(text_col) > limit), text_col, "n_tokens", vocabulary).filter(F.col("n_tokens") > limit)


def split(docs: DataFrame, limit: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece_no, start_token, end_token, n_tokens, piece) of each document over the limit.

    Documents within the limit, empty ones and nulls have no rows: they stay as they are. Repeated rows are cut each. The overlap must be smaller
    than the limit. An empty table gives no rows.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and smaller than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist()):
                pieces = split_text(t, limit, overlap, vocabulary)
                k = len(pieces)
                if k < 2:  # within the limit
                    continue
                yield pa.RecordBatch.from_pydict({"id": pa.array([i] * k, pa.int64()), "piece_no": pa.array(range(k), pa.int32()), "start_token": pa.array([p[0] for p in pieces], pa.int64()), "end_token": pa.array([p[1] for p in pieces], pa.int64()), "n_tokens": pa.array([p[2] for p in pieces], pa.int64()), "piece": pa.array([p[3] for p in pieces])})

    big = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter(F.octet_length("t") > limit)
    # few rows with much work each: spread over all tasks, however few files hold them
    big = big.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return big.mapInArrow(run, "id long, piece_no int, start_token long, end_token long, n_tokens long, piece string").withColumnRenamed("id", id_col)
