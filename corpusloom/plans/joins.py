"""Joins whose strategy follows a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.storage import materialize

#: Rows of a side that may be broadcast. At under 100 bytes a row this is at most about 20 MB in each executor.
BROADCAST_ROWS = 200_000


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left_semi", limit: int = BROADCAST_ROWS, salt: int = 16) -> DataFrame:
    """Join ``left`` with a side of narrow rows whose size isn't known beforehand.

    ``right`` is written first and counted. Up to ``limit`` rows it is broadcast. Beyond, both sides are shuffled on the keys and
    a salt: ``right`` is copied ``salt`` times and each row of ``left`` takes one copy, so a key that holds a third of ``left``
    is spread over ``salt`` tasks. Only joins that keep rows of ``left`` once per match are meant (inner, left, left_semi,
    left_anti). Null keys match nothing, as in SQL.
    """
    right = materialize(right, "side")
    if right.count() <= limit:
        return left.join(F.broadcast(right), on, how)
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salt)).cast("int"))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")
