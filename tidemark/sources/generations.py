"""A table of the newest row per key, kept over runs as a base and a few deltas per partition.

A run writes the keys it changed as one delta, in folders of the partitions it touches. Every so
many runs the deltas are merged, only in partitions that have some, into a new base, and what it
replaces is deleted, so that a partition has one base and a bounded number of deltas. A repeated
run sees what was there before it and overwrites its own delta; a merge counts only once its job
has committed, and is not done twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import keyed
from tidemark.session import delete, entries, exists, make_folder

EVERY = 8  # runs between merges


class Generations:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], columns: str, partition: str, partition_type: str, every: int = EVERY):
        """``columns``: name and type of all columns but ``partition``, which is one of the columns of every row."""
        self.spark, self.path, self.keys, self.every, self.partition = spark, path, keys, every, partition
        self.schema = f"{columns}, generation bigint, {partition} {partition_type}"
        self.names = [c.split()[0] for c in columns.split(", ")] + [partition]
        for kind in ("base", "delta"):
            make_folder(spark, f"{path}/{kind}")

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in entries(self.spark, f"{self.path}/{kind}") if n.startswith("generation="))

    def merged(self) -> int:
        """Last run that is part of a base; -1 if there is none."""
        done = [g for g in self._numbers("base") if exists(self.spark, f"{self.path}/base/generation={g}/_SUCCESS")]
        return max(done, default=-1)

    def rows(self, before: int) -> DataFrame:
        """What runs before ``before`` left: rows of a key may be several, the one of the largest generation counts."""
        base, last = self.spark.read.schema(self.schema).parquet(f"{self.path}/base"), self.merged()
        delta = self.spark.read.schema(self.schema).parquet(f"{self.path}/delta")
        return base.where(F.col("generation") <= last).unionByName(delta.where((F.col("generation") < before) & (F.col("generation") > last)))

    def newest(self, before: int, partitions: DataFrame | None = None) -> DataFrame:
        """Newest row per key, of the given partitions only where they are named."""
        rows = self.rows(before)
        if partitions is not None:
            rows = rows.join(partitions.select(self.partition).distinct(), self.partition, "left_semi")
        rest = [c for c in self.names if c not in self.keys]
        return keyed.latest(rows, self.keys, [F.col("generation")], rest)

    def settled(self, run: int) -> bool:
        """Whether ``run`` is part of a base already, so that repeating it must not change anything."""
        return run <= self.merged()

    def add(self, rows: DataFrame, run: int) -> None:
        """The changed keys of a run, each once."""
        target = f"{self.path}/delta/generation={run}"
        rows.select(*self.names).hint("rebalance", self.partition).write.mode("overwrite").partitionBy(self.partition).parquet(target)

    def tidy(self, run: int) -> None:
        """Before every ``every``-th run: merge what earlier runs left."""
        if run <= 0 or run % self.every:
            return
        upto, deltas = run - 1, self._numbers("delta")
        target = f"{self.path}/base/generation={upto}"
        if self.merged() < upto and any(g <= upto for g in deltas):
            touched = self.rows(run).where(F.col("generation") > self.merged()).select(self.partition).distinct()
            whole = self.newest(run, touched).hint("rebalance", self.partition)
            whole.write.mode("overwrite").partitionBy(self.partition).parquet(target)
        if self.merged() < upto:
            return
        for g in deltas:
            if g <= upto:
                delete(self.spark, f"{self.path}/delta/generation={g}")
        fresh = {n for n in entries(self.spark, target) if "=" in n}
        for g in self._numbers("base"):
            if g < upto:
                folder = f"{self.path}/base/generation={g}"
                left = {n for n in entries(self.spark, folder) if "=" in n}
                for n in left & fresh:
                    delete(self.spark, f"{folder}/{n}")
                if left <= fresh:
                    delete(self.spark, folder)

