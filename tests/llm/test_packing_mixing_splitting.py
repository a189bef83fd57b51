"""Problems 8 to 10: round trips and brute force."""

import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import mixing, packing, splitting
from corpusloom.llm.tokens import counter, encoder, with_tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 5))
def test_packer_keeps_capacity(sizes, slots):
    p, fill = packing.Packer(50, slots), {}
    for s in sizes:
        b = p.add(s)
        fill[b] = fill.get(b, 0) + s
        assert len(p.room) <= slots
    assert all(v <= 50 for v in fill.values()) and sum(fill.values()) == sum(sizes)
    assert p.take_closed() | p.leftovers() == fill


def test_pack(spark):
    rows = [(i, random.Random(i).randint(0, 300)) for i in range(3000)] + [(5000, 1234), (5001, None), (None, 7), (5002, 100), (5002, 100)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("size", F.lit("clash")).repartition(6)
    out = packing.pack(df, 500, slots=16)
    got = out.collect()
    per, items = {}, {}
    for r in got:
        per[r["container_id"]] = per.get(r["container_id"], 0) + r["n_tokens"]
        items.setdefault(r["doc_id"], []).append((r["piece_no"], r["n_tokens"]))
    want = {i: n for i, n in rows if i is not None and n and i != 5002}
    assert {i: sum(n for _, n in v) for i, v in items.items() if i != 5002} == want
    assert sorted(items[5000]) == [(0, 500), (1, 500), (2, 234)] and [n for _, n in items[5002]] == [100, 100]
    assert max(per.values()) <= 500
    rep = packing.fill_report(out, 500).first()
    assert rep["filled"] > 0.95 and rep["n_items"] == len(got) and rep["least"] <= rep["n_containers"]
    assert packing.pack(df.limit(0), 500).count() == 0 and packing.fill_report(packing.pack(df.limit(0), 500), 500).first()["n_containers"] == 0


def test_shares():
    t = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.1, 9)]
    take = mixing.shares(t, {"a": 1000, "b": 100, "c": 1000})
    assert take["b"] == 200 and take["gone"] == 0 and take["a"] == 1000 and abs(sum(take.values()) - 2100) <= 3
    assert mixing.shares(t, {"a": 1000, "b": 1000, "c": 1000}, 100) == {"a": 50, "b": 30, "c": 20, "gone": 0}
    assert mixing.shares([], {}) == {} and mixing.shares([("a", 1.0, 0)], {"a": 5}) == {"a": 0}


def test_running_sum(spark):
    rows = [(i % 3, i // 50, i, i * 7 % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, c int, o int, v long")
    want = {}
    for g, _, o, v in sorted(rows, key=lambda r: r[2]):
        want[o] = want.get(("sum", g), 0)
        want[("sum", g)] = want[o] + v
    assert all(r["s"] == want[r["o"]] for r in mixing.running_sum(df, ["g"], ["o"], "v", "c", "s").collect())


def test_mix(spark):
    docs = spark.createDataFrame([(i, "abz"[i % 3], 20 + i % 60) for i in range(900)] + [(2000, "a", None), (2001, None, 5), (None, "a", 5)], "doc_id long, source string, n_tokens long").withColumn("copy_no", F.lit(1))
    small = docs.filter("source <> 'b' or doc_id < 100")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("gone", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(small, targets, block=256)
    got = out.collect()
    assert {r["source"] for r in got} == {"a", "b"}
    uses = {}
    for r in got:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["copy_no"])
    assert all(len(set(v)) == len(v) <= (1 if s == "a" else 3) for (s, _), v in uses.items())
    total = {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in "ab"}
    have = {s: sum(20 + i % 60 for i in range(900) if "abz"[i % 3] == s and (s != "b" or i < 100)) for s in "ab"}
    want = mixing.shares([("a", 0.5, 1), ("b", 0.5, 3)], have)
    assert all(want[s] <= total[s] < want[s] + 80 for s in "ab")
    # any stretch of slots has both sources about as they stand in the whole
    half = sorted(r["slot"] for r in got)[len(got) // 2]
    first = sum(r["n_tokens"] for r in got if r["slot"] <= half and r["source"] == "a") / sum(r["n_tokens"] for r in got if r["slot"] <= half)
    assert abs(first - total["a"] / sum(total.values())) < 0.05
    rep = {r["source"]: r for r in mixing.share_report(out, targets.filter("source is not null")).collect()}
    assert rep["gone"]["share"] == 0 and rep["a"]["tokens"] == total["a"] and abs(rep["a"]["share"] + rep["b"]["share"] - 1) < 1e-9
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.lists(st.tuples(st.integers(1, 59), st.sampled_from(["paragraph", "sentence", "word"])), max_size=20), st.integers(2, 20), st.integers(0, 6))
def test_cut_points(n, ends, limit, overlap):
    overlap = min(overlap, limit - 1)
    cuts = splitting.cut_points(list(range(n + 1)), dict(ends), limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == n and all(0 < b - a <= limit for a, b in cuts)
    assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in itertools.pairwise(cuts))


def test_cut_points_are_the_best():
    """Against all ways to cut at the boundaries."""
    ends, limit, overlap, n = {4: "word", 6: "paragraph", 9: "word", 12: "sentence", 15: "word"}, 8, 1, 18
    offsets = list(range(n + 1))
    pieces = -(-(n - overlap) // (limit - overlap))
    even = (n - overlap) / pieces + overlap

    def cost(cs):
        out, a = 0.0, 0
        for k, b in enumerate([*cs, n]):
            size = b - a + (overlap if k else 0)
            if size > limit or size <= 0:
                return float("inf")
            out += (splitting.CUT_COST[ends[b]] if b < n else 0.0) + ((size - even) / limit) ** 2
            a = b
        return out

    best = min((cost(cs), cs) for r in range(6) for cs in itertools.combinations(sorted(ends), r))
    assert tuple(b for _, b in splitting.cut_points(offsets, ends, limit, overlap)[:-1]) == best[1]


@pytest.mark.parametrize("text", ["One sentence here. " * 400, "para one\n\npara two is longer\n\n" * 150, "x" * 3000, "日本語の文です。" * 300, "é" * 2000, "\U0001f600" * 500, " " * 5000, "a b\r\n" * 900])
def test_split_text(text):
    count = counter()
    pieces = splitting.split_text(text, 100, 10)
    assert all(count(t) <= 100 for *_, t in pieces) and pieces[0][0] == 0 and pieces[-1][1] == count(text)
    assert all(t in text for *_, t in pieces)
    assert all(b[0] == a[1] - 10 for a, b in itertools.pairwise(pieces))
    enc = encoder()
    tokens = enc.encode_ordinary(text)
    for a, b, n, t in pieces:  # where cuts lie between characters, the piece is just its tokens
        raw = enc.decode_bytes(tokens[a:b])
        try:
            assert raw.decode() == t
        except UnicodeDecodeError:
            assert raw.decode("utf-8", "ignore") in t


def test_split_and_oversized(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "A sentence. " * 200), (3, None), (4, ""), (5, "word " * 101), (5, "word " * 101), (6, "z" * 100)], "doc_id long, text string").withColumn("piece", F.lit(0))
    assert sorted(r["doc_id"] for r in splitting.oversized(docs, 100).collect()) == [2, 5, 5]
    out = splitting.split(docs, 100, 20).collect()
    assert {r["doc_id"] for r in out} == {2, 5} and all(r["n_tokens"] <= 100 for r in out)
    # cuts at the ends of sentences
    assert all(r["piece"].rstrip().endswith(".") for r in out if r["doc_id"] == 2)
    assert splitting.split(docs.limit(0), 100, 20).count() == 0
    with pytest.raises(ValueError):
        splitting.split(docs, 100, 100)


def test_with_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5)], "id long, text string, n_tokens int")
    assert {r["id"]: r["n_tokens"] for r in with_tokens(df).collect()} == {1: 2, 2: 0, 3: 0}
    assert {r["id"]: r["n_tokens"] for r in with_tokens(df, skip_bytes=100).collect()} == {1: -11, 2: 0, 3: 0}


def test_cut_points_are_the_best_of_all_boundaries():
    """Against a plain dynamic program over every boundary, at a limit where a stretch holds many of one kind."""
    rng = random.Random(5)
    n, limit, overlap = 3000, 700, 40
    offsets = list(range(n + 1))
    ends = {i: rng.choice(["word"] * 6 + ["clause", "sentence", "line"]) for i in range(1, n) if rng.random() < 0.5}
    got = splitting.cut_points(offsets, ends, limit, overlap)
    step = limit - overlap
    even = (n - overlap) / -(-(n - overlap) // step) + overlap
    points = [*sorted(i for i in ends if i > overlap), n]
    cost = {}
    for e in points:
        own = 0.0 if e == n else splitting.CUT_COST[ends[e]]
        options = [((e - even) / limit) ** 2] if e <= limit else []
        options += [cost[b] + ((e - b + overlap - even) / limit) ** 2 for b in points if e - step <= b < e and b in cost]
        if options:
            cost[e] = own + min(options)
    mine = sum(((b - a - even) / limit) ** 2 for a, b in got) + sum(splitting.CUT_COST[ends[b]] for _, b in got[:-1])
    assert abs(mine - cost[n]) < 1e-9 and all(b - a <= limit for a, b in got) and all(c == b - overlap for (_, b), (c, _) in zip(got, got[1:]))


def test_mix_of_many_and_rare_sources(spark):
    """More sources than a chain of conditions could hold, and one of a single block beside them: every block gets a slot, shares hold within a block."""
    names_ = [f"s{i}" for i in range(300)]
    docs = spark.createDataFrame([(i * 1000 + k, s, 10) for i, s in enumerate(names_) for k in range(40)] + [(999_999, "rare", 10)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(s, 1.0, 1) for s in names_] + [("rare", 0.0001, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets, block=10).collect()
    assert len({(r["slot"], r["seq"]) for r in got}) == len(got) and len(got) >= 300 * 39
    per = {}
    for r in got:
        per[r["source"]] = per.get(r["source"], 0) + r["n_tokens"]
    assert set(per) >= set(names_) and max(per[s] for s in names_) - min(per[s] for s in names_) <= 10


def test_found_documents_are_those_that_the_splitter_cuts(spark):
    from corpusloom.llm import queries

    folder = "/root/testdata/sf0.001"
    found = queries.p10_found(spark, folder)
    assert "piece_no" in found._jdf.queryExecution().toString()
    most = queries.limit_of(spark, folder, "piece")[0]
    want = sorted(r["doc_id"] for r in splitting.oversized(spark.read.parquet(f"{folder}/documents.parquet"), most).collect())
    assert want and sorted(r["doc_id"] for r in found.collect()) == want


def plain_least(at, own, limit, overlap, even):
    """Every cut within a piece's length is tried for every place, one by one."""
    cost, back = np.full(len(at), np.inf), np.full(len(at), -1)
    for k, e in enumerate(at.tolist()):
        lo = int(np.searchsorted(at, e - (limit - overlap)))
        c = cost[lo:k] + ((e - at[lo:k] + overlap - even) / limit) ** 2
        alone = ((e - even) / limit) ** 2 if e <= limit else np.inf
        i = int(c.argmin()) if k > lo else -1
        cost[k], back[k] = (own[k] + c[i], lo + i) if i >= 0 and c[i] < alone else (own[k] + alone, -1)
    return back


def test_places_in_blocks_give_what_every_cut_gives():
    """The same cuts as by trying each one, also where pieces are short against a block, where all cuts cost alike and where whole stretches have none; and with less work."""
    rng = random.Random(11)
    for n, limit, overlap, dense, costs in itertools.product((40, 2500), (9, 100, 700), (0, 8), (0.1, 0.9), ([1.5], [0.0], [0.0, 0.15, 0.3, 0.8, 1.5, 4.0])):
        at = np.array([*sorted({i for i in range(overlap + 1, n) if rng.random() < dense}), n])
        own = np.array([rng.choice(costs) for _ in at[1:]] + [0.0])
        even = (n - overlap) / -(-(n - overlap) // (limit - overlap)) + overlap
        assert splitting._least(at, own, limit, overlap, even).tolist() == plain_least(at, own, limit, overlap, even).tolist()
    at, took = np.arange(201, 30_000), []
    own = np.array([rng.choice([1.5] * 9 + [0.3]) for _ in at])
    for f in (splitting._least, plain_least):
        began = time.process_time()
        f(at, own, 4096, 200, 3900.0)
        took.append(time.process_time() - began)
    assert took[0] * 2 < took[1]
