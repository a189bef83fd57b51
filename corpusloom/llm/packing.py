"""Problem 8: fill containers of fixed capacity with whole items.

Bounded-space online packing: every partition keeps a fixed number of open containers and places each item into the one it fills best; if
none has room, the fullest leaves and a new one opens. The items of containers that are open and not full at the end of a partition are merged with the leftovers of
others in rounds, each over fewer partitions, largest first by the same rule, until one partition is left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.storage import materialize

OPEN = 64
#: An open container with less room than this share of its capacity is full at the end of a partition.
FULL = 0.01
#: So many partitions' leftovers come together in one partition of the next round.
FAN_IN = 32


class Packer:
    """Best fit over at most ``slots`` open containers. ``add`` gives the number of the container that took the item."""

    def __init__(self, capacity: int, slots: int = OPEN):
        self.capacity, self.slots, self.next = capacity, slots, 0
        self.room: list[tuple[int, int]] = []  # (room left, container), sorted
        self.closed: dict[int, int] = {}  # container -> fill, since the last call of take_closed

    def add(self, size: int) -> int:
        i = bisect_left(self.room, (size, -1))
        if i < len(self.room):
            room, box = self.room.pop(i)
        else:
            if len(self.room) >= self.slots:
                left, gone = self.room.pop(0)  # the fullest
                self.closed[gone] = self.capacity - left
            room, box = self.capacity, self.next
            self.next += 1
        insort(self.room, (room - size, box))
        return box

    def take_closed(self) -> dict[int, int]:
        out, self.closed = self.closed, {}
        return out

    def leftovers(self) -> dict[int, int]:
        return {box: self.capacity - room for room, box in self.room}


def split_sizes(size: int, capacity: int) -> list[int]:
    """An item over the capacity as full containers and a rest; others whole."""
    return [size] if size <= capacity else [capacity] * (size // capacity) + ([size % capacity] if size % capacity else [])


def _partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _place(items: DataFrame, capacity: int, slots: int, round_no: int) -> DataFrame:
    """items (item, part, size) -> (item, part, size, box, open): box is the round, partition and number of the container; items of open ones may be placed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (round_no << 56) | (_partition_id() << 32)
        packer = Packer(capacity, slots)
        held: dict[int, list[tuple[int, int, int]]] = {}  # rows of open containers

        def rows(boxes, open_):
            out = [(i, p, s, base | b, open_) for b in boxes for i, p, s in held.pop(b, [])]
            names = ("item", "part", "size", "box", "open")
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, types))})

        for b in batches:
            for item, part, size in zip(b.column("item").to_pylist(), b.column("part").to_pylist(), b.column("size").to_pylist()):
                for k, s in enumerate(split_sizes(size, capacity)):
                    held.setdefault(packer.add(s), []).append((item, part + k, s))
            if done := packer.take_closed():
                yield rows(done, False)
        full = [b for b, fill in packer.leftovers().items() if capacity - fill < FULL * capacity]
        yield rows([*packer.take_closed(), *full], False)
        yield rows([*packer.leftovers()], True)

    return items.mapInArrow(run, "item long, part int, size long, box long, open boolean")


def pack(items: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", slots: int = OPEN) -> DataFrame:
    """(id, piece, size, container): each item once, in containers of at most ``capacity``.

    An item over the capacity is split into full pieces and a rest, numbered from 0. Items of size 0 or null or with a null id take
    no room and get no row. Repeated rows are items of their own. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    base = items.select(F.col(id_col).cast("long").alias("item"), F.lit(0).alias("part"), F.col(size_col).cast("long").alias("size")).filter("item is not null and size > 0")
    placed = materialize(_place(base, capacity, slots, 0), "packed")
    parts = (placed.agg(F.max(F.expr("(box >> 32) & 16777215"))).first()[0] or 0) + 1
    out, round_no = placed.filter("not open"), 0
    while parts > 1:
        parts, round_no = -(-parts // FAN_IN), round_no + 1
        # of each partition only what it held open: a bounded number of containers. Sorted, so a task that runs again packs alike
        near = placed.filter("open").select("item", "part", "size", (F.expr("(box >> 32) & 16777215") % parts).cast("int").alias("to"))
        near = near.repartition(parts, "to").sortWithinPartitions(F.desc("size"), "item", "part").select("item", "part", "size")
        placed = materialize(_place(near, capacity, slots, round_no), "merged")
        out = out.unionByName(placed.filter("not open"))
    out = out.unionByName(placed.filter("open"))
    return out.select(F.col("item").alias(id_col), F.col("part").alias("piece_no"), F.col("size").alias(size_col), F.col("box").alias("container_id"))


def fill_report(packed: DataFrame, capacity: int, size_col: str = "n_tokens") -> DataFrame:
    """One row: containers, items, tokens, the least number of containers they could need, and the share of room filled."""
    per = packed.groupBy("container_id").agg(F.sum(size_col).alias("fill"), F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("fill"), F.lit(0)).alias("n_tokens"), F.ceil(F.coalesce(F.sum("fill"), F.lit(0)) / capacity).alias("least"),
        F.coalesce(F.max("fill"), F.lit(0)).alias("max_fill"), (F.coalesce(F.sum("fill"), F.lit(0)) / F.greatest(F.count("*") * capacity, F.lit(1))).alias("filled"),
    )
