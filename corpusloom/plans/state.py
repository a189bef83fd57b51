"""The state of a crawl: a folder for each round, committed as a whole.

``<root>/round=N/{frontier,visited,outcomes,...}`` and then an empty ``_COMMITTED``. A round without it never happened. Paths go through Hadoop's file
systems, so a root may lie on any that the cluster has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CrawlState:
    """Reads and commits rounds below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def rounds(self) -> list[int]:
        """The committed rounds in order."""
        fs, root = self._fs(), self._path(self.root)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = [int(n[6:]) for n in names if n.startswith("round=")]
        return sorted(n for n in found if fs.exists(self._path(f"{self.root}/round={n}/_COMMITTED")))

    def commit(self, n: int, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write the tables of round ``n`` and mark it committed; what an aborted try left is replaced. The tables read back."""
        base = f"{self.root}/round={n}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")
        self._fs().create(self._path(f"{base}/_COMMITTED"), True).close()
        return {name: self.read(n, name) for name in tables}

    def read(self, n: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/round={n}/{name}")

    def read_all(self, name: str, last: int | None = None) -> DataFrame | None:
        """A table of all committed rounds, up to ``last``."""
        ns = [n for n in self.rounds() if last is None or n <= last]
        return self.spark.read.parquet(*[f"{self.root}/round={n}/{name}" for n in ns]) if ns else None

    def stats(self) -> DataFrame | None:
        """The counters that the committed rounds stored, summed for each domain."""
        rows = self.read_all("stats")
        return rows.groupBy("netloc").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "netloc"]) if rows is not None else None

    def known_hashes(self) -> DataFrame | None:
        """(netloc, hash) of the files of all committed rounds."""
        rows = self.read_all("files")
        return rows.select("netloc", "hash").distinct() if rows is not None else None

    def clear(self) -> None:
        """Forget everything."""
        self._fs().delete(self._path(self.root), True)
