"""Keys that are unique for good, over any number of deliveries.

All keys ever accepted are stored by bucket, with one Bloom filter of fixed size per bucket. A
batch is first held against the filters: most new keys are told apart by them. Only keys that a
filter may hold are looked up, and only their buckets are read. A full filter costs reads, never
an answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import keyed
from tidemark.session import materialise
from tidemark.sources.generations import EVERY, Generations
from tidemark.streaming import runs

BUCKETS, BITS, PROBES = 64, 1 << 19, 4  # 64 KB a bucket: 4 MB of filters, good for some four million keys


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key: steps of an odd width from a start, both taken from its hash."""
    h = hashes.astype("uint64")
    start, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((start[:, None] + np.arange(PROBES, dtype="uint64") * step[:, None]) % np.uint64(bits)).astype("int64")


def _held(filters: pd.DataFrame, bits: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(filters["bits"].iloc[0], "uint8")) if len(filters) else np.zeros(bits, "uint8")


def _ask(bits: int):
    def run(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        held = _held(filters, bits)[_places(keys["hash"].to_numpy(), bits)].all(axis=1)
        return keys[["bucket", "id"]].assign(maybe=held.astype(bool))

    return run


def _note(bits: int):
    def run(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if keys.empty:
            return pd.DataFrame({"bucket": [], "bits": []})
        held = _held(filters, bits).copy()
        held[_places(keys["hash"].to_numpy(), bits).ravel()] = 1
        return pd.DataFrame({"bucket": [int(keys["bucket"].iloc[0])], "bits": [np.packbits(held).tobytes()]})

    return run


class UniqueKeys:
    """Store of all keys accepted so far; ``buckets`` and ``bits`` (a multiple of 8) stay the same for its life."""

    def __init__(self, spark: SparkSession, path: str, every: int = EVERY, buckets: int = BUCKETS, bits: int = BITS):
        self.buckets, self.bits = buckets, bits
        self.keys = Generations(spark, f"{path}/keys", ["id"], "id string", "bucket", "int", every)
        self.filters = Generations(spark, f"{path}/filters", ["bucket"], "bits binary", "bucket", "int", every)

    def placed(self, ids: DataFrame) -> DataFrame:
        return ids.select("id", F.xxhash64("id").alias("hash")).withColumn("bucket", F.pmod("hash", F.lit(self.buckets)).cast("int"))

    def maybe(self, ids: DataFrame, run: int) -> DataFrame:
        """``ids`` (bucket, id, hash) with whether their bucket's filter may hold them."""
        filters = self.filters.newest(run, ids)
        return ids.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_ask(self.bits), "bucket int, id string, maybe boolean")

    def accept(self, ids: DataFrame, run: int) -> DataFrame:
        """The ids (distinct, not null) that no earlier run accepted; they are stored. A repeated run gives the same answer."""
        for store in (self.keys, self.filters):
            store.tidy(run)
        spark = ids.sparkSession
        placed = materialise(spark, self.placed(ids), "ids")
        asked = materialise(spark, self.maybe(placed, run), "asked")
        doubtful = asked.where("maybe").select("bucket", "id")
        known = self.keys.newest(run, doubtful).select("bucket", "id")
        fresh = materialise(spark, placed.join(doubtful.join(known, ["bucket", "id"]).select("id"), "id", "left_anti"), "fresh")
        self.keys.add(fresh, run)
        filters = self.filters.newest(run, fresh)
        self.filters.add(fresh.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_note(self.bits), "bucket int, bits binary"), run)
        return fresh.select("id")


def first_ever(store: UniqueKeys, rows: DataFrame, key: str, order: list[str], run: int) -> DataFrame:
    """Rows of ``key`` values that never came before, the first by ``order`` of each; rows without key all pass."""
    payload = [c for c in rows.columns if c != key]
    first = keyed.earliest(rows.where(F.col(key).isNotNull()), [key], [F.col(c) for c in order], payload)
    fresh = store.accept(first.select(F.col(key).cast("string").alias("id")), run)
    passed = first.join(fresh, F.col(key).cast("string") == F.col("id"), "left_semi").select(*rows.columns)
    return passed.unionByName(rows.where(F.col(key).isNull()))


def unique_deliveries(stream: DataFrame, out: str, key: str, order: list[str]) -> DataFrame:
    """Run the stream over what is available; returns the table of rows whose key was new."""
    spark = stream.sparkSession
    store = UniqueKeys(spark, f"{out}/unique")

    def handle(batch: DataFrame, run: int) -> None:
        runs.batch_writer(f"{out}/accepted")(first_ever(store, batch, key, order, run), run)

    runs.drain_batches(stream, f"{out}/checkpoint", handle)
    return spark.read.parquet(f"{out}/accepted").select(*stream.columns)
