"""Problem 9: mix sources to target weights.

A low-discrepancy schedule: the points of the golden-ratio sequence are mapped through the sources' cumulative weights, so any stretch of
slots holds each source in its share. The slots of a source are ranked and joined with the source's shuffled text cut into blocks of
equal tokens. A source that is used up begins again in another order, up to its number of repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.plans.storage import materialize

GOLDEN = (math.sqrt(5) - 1) / 2
#: Tokens of a block, rows that one task orders, and the most sources a table of targets may have.
BLOCK, CHUNK, MOST_SOURCES = 4096, 50_000, 10_000
#: A source with fewer blocks than this part of all has its slots spread evenly; the sequence takes those of the others.
RARE = 1000


def shares(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens to take of each source.

    Every source gets its share of ``total`` (by default all that the sources have, once), but at most its tokens times its repeats;
    what such a source lacks is spread over the others by their shares (raising one level until the total is met or all are used up).
    """
    cap = {s: available.get(s, 0) * max(0, r) for s, w, r in targets}
    want = {s: max(0.0, w) for s, w, _ in targets}
    goal = min(sum(available.get(s, 0) for s in cap) if total is None else total, sum(c for s, c in cap.items() if want[s] > 0))
    take = dict.fromkeys(cap, 0)
    free = {s for s in cap if want[s] > 0 and cap[s] > 0}
    left = goal
    while free and left > 0:
        level = left / sum(want[s] for s in free)
        full = {s for s in free if cap[s] <= level * want[s]}
        if not full:
            for s in free:
                take[s] = int(level * want[s])
            break
        for s in full:
            take[s] = cap[s]
            left -= cap[s]
        free -= full
    return take


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, chunk: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows before a row in its group. ``chunk`` numbers stretches of the order, each small enough for a task.

    Two levels: sums of chunks are summed up first, so no group, however large, comes into one task.
    """
    per = df.groupBy(*group, chunk).agg(F.sum(value).alias("__s"))
    before = per.withColumn("__before", F.sum("__s").over(W.partitionBy(*group).orderBy(chunk)) - F.col("__s")).drop("__s")
    inside = F.sum(value).over(W.partitionBy(*group, chunk).orderBy(*order)) - F.col(value)
    return df.join(before, [*group, chunk]).withColumn(out, inside + F.col("__before")).drop("__before")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 7, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(slot, seq, id, source, copy_no, n_tokens): the mixture in order of slot and seq.

    docs: (id, source, n_tokens). targets: (source, target_share, max_repeats), at most ``MOST_SOURCES`` rows; they are read to the
    driver. Documents of other sources, with a null source or id, or without tokens take no part. Copies are numbered from 0. A
    document stands in the block in which it begins and is never cut, so a source exceeds its tokens by less than one document.
    Repeated target rows of one source: their shares are added and the most repeats hold. Empty tables give no rows.
    """
    rows = targets.filter("source is not null and target_share is not null").groupBy("source").agg(F.sum("target_share"), F.max(F.coalesce("max_repeats", F.lit(1)))).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark = docs.sparkSession
    want = sorted((r[0], float(r[1]), int(r[2])) for r in rows)
    names = [s for s, *_ in want]
    own = docs.select(F.col(id_col).cast("long").alias("id"), "source", F.col(size_col).cast("long").alias("n")).filter(F.col("n") > 0).filter("id is not null")
    own = materialize(own.filter(F.col("source").isin(names)) if names else own.limit(0), "mix")
    have = {r["source"]: (r["n"], r["k"]) for r in own.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    take = shares(want, {s: n for s, (n, _) in have.items()}, total)
    plan = [(s, take[s], have[s][0], -(-take[s] // have[s][0]), max(1, -(-have[s][1] // CHUNK))) for s in names if take.get(s)]
    if not plan:
        return spark.createDataFrame([], f"slot long, seq int, {id_col} long, source string, copy_no int, {size_col} long")
    table = F.broadcast(spark.createDataFrame(plan, "source string, take long, have long, copies long, chunks long"))
    # the shuffled stream of each source, one pass after the other
    stream = own.join(table, "source").select("id", "source", "n", "take", "have", "chunks", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy_no"))
    stream = stream.withColumn("h", F.xxhash64("id", "copy_no", F.lit(seed)))
    # chunks are ranges of the hash, in its order
    stream = stream.withColumn("chunk", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("chunks")).cast("int"))
    placed = running_sum(stream, ["source", "copy_no"], ["h", "id", "n"], "n", "chunk", "at").withColumn("at", F.col("at") + F.col("copy_no") * F.col("have")).filter("at < take")
    blocks = placed.select("id", "source", "copy_no", "n", "at", F.floor(F.col("at") / block).cast("long").alias("rank"))
    # slots: enough for each source's blocks; a point beyond a source's need is dropped
    need = {s: -(-t // block) for s, t, *_ in plan}
    total_need = sum(need.values())
    # a source of few blocks would need very many points until its last: it takes the slots of an even spread of its own
    rare = {s: n for s, n in need.items() if n * RARE < total_need}
    level, bands = 0, []
    for s in need:
        if s not in rare:
            level += need[s]
            bands.append((level, s))
    tops, of = np.array([t for t, _ in bands]) / level, [s for _, s in bands]
    # the sequence's discrepancy is at most about 3 ln(n) / n: so many points more reach every source's last block
    points = level + int((8 + 4 * math.log(level + 1)) * max(level / need[s] for s in of))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_ = pa.array(of, pa.string())
        for b in batches:
            x = b.column(0).to_numpy() * GOLDEN + 0.5
            yield pa.RecordBatch.from_arrays([b.column(0), names_.take(pa.array(np.minimum(np.searchsorted(tops, x - np.floor(x), "right"), len(of) - 1)))], names=["slot", "source"])

    slots = spark.range(points).mapInArrow(pick, "slot long, source string").withColumn("one", F.lit(1)).withColumn("chunk", F.floor(F.col("slot") / CHUNK).cast("int"))
    ranked = running_sum(slots, ["source"], ["slot"], "one", "chunk", "rank").select("slot", "source", F.col("rank").cast("long").alias("rank"))
    if rare:
        even = spark.createDataFrame([(s, n) for s, n in rare.items()], "source string, n long").select("source", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("rank"))
        ranked = ranked.unionByName(even.select(F.floor((F.col("rank") + 0.5) / F.col("n") * total_need).cast("long").alias("slot"), "source", "rank"))
    joined = blocks.join(ranked, ["source", "rank"])
    return joined.withColumn("seq", (F.row_number().over(W.partitionBy("slot").orderBy("source", "at", "id")) - 1).cast("int")).select("slot", "seq", F.col("id").alias(id_col), "source", F.col("copy_no").cast("int"), F.col("n").alias(size_col))


def share_report(mixed: DataFrame, targets: DataFrame, size_col: str = "n_tokens", id_col: str = "doc_id") -> DataFrame:
    """(source, target_share, tokens, share, copies, max_repeats) of each target; sources without text have share 0."""
    per = mixed.groupBy("source").agg(F.sum(size_col).alias("tokens"), (F.max("copy_no") + 1).alias("copies"))
    whole = per.agg(F.sum("tokens").alias("whole"))
    j = targets.join(per, "source", "left").crossJoin(F.broadcast(whole))  # whole is one row
    return j.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share"), F.coalesce("copies", F.lit(0)).alias("copies"), "max_repeats")
