"""Pivot-partitioned vector table with exact pruning by the triangle inequality.

Every vector belongs to the cell of its nearest pivot and is stored with its distance to it (its
radius). Cells are cut, in order of radius, into blocks of bounded size, so a block is a ring
around its pivot. A query needs only the blocks whose ring may hold something nearer than the k
vectors it already has from a first probe: for a vector x of cell c, ``d(q, x)`` is at least
``|d(q, c) - radius(x)|``, and at least half of how much farther q is from c than from any other
pivot. The table is partitioned by cell, so cells that no query needs aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import keyed
from tidemark.session import fresh_path, materialise

CELLS = 1024  # at most; about the root of the number of vectors otherwise
SAMPLE_ROWS = 16_384  # vectors that the pivots are fitted on, at most
BLOCK_ROWS, QUERY_BLOCK, PROBE_BLOCKS = 512, 256, 4
ROUNDS = 4  # of moving the pivots to the means of the sample
SLACK = 2e-6  # distances are compared rounded to six decimals

_BLOCKS = "cell int, block long, low double, high double, n long, vec_ids array<long>, points array<double>"
_NEEDS = "query_id long, embedding array<double>, bound double, cell int, gap double"


@dataclass(frozen=True)
class Index:
    """Where the blocks lie, and what pruning needs about cells: one row each, ``CELLS`` at most."""

    path: str
    pivots: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows of ``a`` and ``b``; ``b`` is small."""
    return np.stack([np.sqrt(((a - row) ** 2).sum(axis=1)) for row in b], axis=1)


def fit_pivots(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of ``cells`` groups of the sample: evenly spread first rows, then a few rounds of moving."""
    pivots = np.unique(sample[:: max(1, len(sample) // cells)][:cells], axis=0)
    for _ in range(ROUNDS):
        own = _distances(sample, pivots).argmin(axis=1)
        pivots = np.stack([sample[own == c].mean(axis=0) if (own == c).any() else pivots[c] for c in range(len(pivots))])
    return pivots


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            gaps = _distances(_matrix(batch.column("embedding")), pivots)
            cell = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(gaps[np.arange(len(cell)), cell]), batch.column("vec_id"), batch.column("embedding")],
                names=["cell", "radius", "vec_id", "embedding"],
            )

    return run


def _blocks_of(block_rows: int):
    """Runs of up to ``block_rows`` rows of one cell, from rows in order of cell and radius."""

    def block(rows: pa.RecordBatch, number: int) -> pa.RecordBatch:
        radius, points = rows.column("radius").to_numpy(), rows.column("embedding")
        return pa.RecordBatch.from_arrays(
            [rows.column("cell").slice(0, 1), pa.array([number]), pa.array([radius.min()]), pa.array([radius.max()]), pa.array([len(rows)]),
             pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([points.flatten().to_numpy(zero_copy_only=False)], pa.list_(pa.float64()))],
            names=["cell", "block", "low", "high", "n", "vec_ids", "points"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            cells, start = rows.column("cell").to_numpy(), 0
            while start < len(cells):
                end = min(start + block_rows, int(np.searchsorted(cells, cells[start], "right")))
                if end == len(cells) and end - start < block_rows:
                    break  # more rows of the cell may follow
                yield block(rows.slice(start, end - start), number)
                start, number = end, number + 1
            held = rows.slice(start) if start < len(cells) else None
        if held is not None and held.num_rows:
            yield block(held, number)

    return run


def build(vectors: DataFrame, cells: int | None = None, path: str | None = None) -> Index | None:
    """Index of ``vectors`` (vec_id, embedding); rows without embedding, or not as wide as the first sampled one, match nothing.

    Pivots are fitted on at most ``SAMPLE_ROWS`` vectors, taken by the hash of their ids; every
    vector is indexed. None if there is nothing to index.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = usable.count()
    part = usable if n <= SAMPLE_ROWS else usable.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < (1 << 20) * SAMPLE_ROWS // n)
    sample = [r["embedding"] for r in part.limit(SAMPLE_ROWS).collect()]
    if not sample:
        return None
    sample = np.array(sorted(v for v in sample if len(v) == len(sample[0])))
    pivots = fit_pivots(sample, cells or min(CELLS, max(1, int(n**0.5))))
    path = path or fresh_path(spark, "vector-index")
    (
        usable.where(F.size("embedding") == sample.shape[1]).mapInArrow(_assign(pivots), "cell int, radius double, vec_id long, embedding array<double>")
        .repartitionByRange("cell", "radius", "vec_id").sortWithinPartitions("cell", "radius")
        .mapInArrow(_blocks_of(BLOCK_ROWS), _BLOCKS).write.partitionBy("cell").parquet(path)
    )
    rows, low, high = np.zeros(len(pivots)), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in blocks(spark, path).groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        rows[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    return Index(path, pivots, rows, low, high)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(path)


def _cells_to_probe(index: Index, k: int, probes: int | None):
    """The nearest cells that hold k vectors together (or the ``probes`` nearest ones), with the query's distance to their pivots."""

    def choose(gaps: np.ndarray, bound: float) -> np.ndarray:
        order = np.argsort(gaps, kind="stable")
        order = order[index.rows[order] > 0]
        return order[:probes] if probes else order[: int(np.searchsorted(np.cumsum(index.rows[order]), k)) + 1]

    return choose


def _cells_in_reach(index: Index):
    """Cells that may hold a vector within the bound of the query."""

    def choose(gaps: np.ndarray, bound: float) -> np.ndarray:
        least = np.maximum(np.maximum(gaps - index.high, index.low - gaps), (gaps - gaps.min()) / 2)
        return np.flatnonzero((index.rows > 0) & (least <= bound))

    return choose


def _needs(index: Index, choose):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = batch.column("bound").to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                target = np.array(batch.column("embedding")[i].as_py())
                gaps = np.sqrt(((index.pivots - target) ** 2).sum(axis=1))
                cells = choose(gaps, bounds[i])
                row = batch.slice(i, 1).take(pa.array([0] * len(cells), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [row.column("query_id"), row.column("embedding"), row.column("bound"), pa.array(cells, pa.int32()), pa.array(gaps[cells])],
                    names=["query_id", "embedding", "bound", "cell", "gap"],
                )

    return run


def _top_of_block(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, queries in zip(batch.column("vec_ids"), batch.column("points"), batch.column("queries")):
                ids = ids.values.to_numpy()
                points = points.values.to_numpy().reshape(len(ids), -1)
                rows = queries.values
                for query_id, target, bound in zip(rows.field("query_id").to_pylist(), _matrix(rows.field("embedding")), rows.field("bound").to_pylist()):
                    gap = np.floor(np.sqrt(((points - target) ** 2).sum(axis=1)) * 1e6 + 0.5) / 1e6
                    near = np.flatnonzero(gap <= bound)
                    keep = near[np.lexsort((ids[near], gap[near]))[:k]]
                    yield pa.record_batch(
                        [pa.array([query_id] * len(keep), pa.int64()), pa.array(ids[keep], pa.int64()), pa.array(gap[keep])],
                        names=["query_id", "vec_id", "distance"],
                    )

    return run


def _compare(spark: SparkSession, index: Index, pairs: DataFrame, lanes: int, k: int, cells: list[int] | None = None) -> DataFrame:
    """Nearest k in each (query, block) pair; the queries of a block are compared ``QUERY_BLOCK`` or so at a time."""
    lane = F.pmod(F.xxhash64("query_id"), F.lit(lanes))
    asked = pairs.groupBy("cell", "block", lane.alias("lane")).agg(F.collect_list(F.struct("query_id", "embedding", "bound")).alias("queries"))
    held = blocks(spark, index.path).select("cell", "block", "vec_ids", "points")
    if cells is not None:
        held = held.where(F.col("cell").isin(cells))
    return held.join(asked, ["cell", "block"]).select("vec_ids", "points", "queries").mapInArrow(
        _top_of_block(k), "query_id long, vec_id long, distance double"
    )


def needed(spark: SparkSession, index: Index, queries: DataFrame, k: int, lanes: int) -> DataFrame:
    """(query, block) pairs that the exact answer needs, given the k-th distance of a first probe."""
    rings = blocks(spark, index.path).select("cell", "block", "low", "high")
    away = F.greatest(F.lit(0.0), F.col("gap") - F.col("high"), F.col("low") - F.col("gap"))
    endless = queries.withColumn("bound", F.lit(float("inf")))
    probes = endless.mapInArrow(_needs(index, _cells_to_probe(index, k, None)), _NEEDS).join(rings, "cell")
    probes = keyed.top_per_key(probes, ["query_id", "cell"], [away, F.col("block")], PROBE_BLOCKS).drop("rank")
    found = keyed.top_per_key(_compare(spark, index, probes, lanes, k), ["query_id"], [F.col("distance"), F.col("vec_id")], k)
    bounds = found.groupBy(F.col("query_id").alias("_q")).agg(F.max("distance").alias("d"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= k, F.col("d") + SLACK).otherwise(F.lit(float("inf")))
    bounded = queries.join(bounds, F.col("query_id") == F.col("_q"), "left").select("query_id", "embedding", bound.alias("bound"))
    return bounded.mapInArrow(_needs(index, _cells_in_reach(index)), _NEEDS).join(rings, "cell").where(away <= F.col("bound"))


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, vec_id, distance, rank of the k nearest vectors of every query (query_id, embedding).

    Exact; ties go to the smaller vec_id. With ``probes`` only the blocks of that many nearest
    cells are compared, which is approximate. Queries without embedding, or of another width
    than the vectors, have no answer. What reaches the driver is two counts and cell numbers.
    """
    wide = F.size("embedding") == index.pivots.shape[1]
    queries = queries.where(F.col("embedding").isNotNull() & wide).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = materialise(spark, queries, "queries")
    lanes = max(1, -(-queries.count() // QUERY_BLOCK))
    if probes:
        endless = queries.withColumn("bound", F.lit(float("inf")))
        rings = blocks(spark, index.path).select("cell", "block")
        pairs = endless.mapInArrow(_needs(index, _cells_to_probe(index, k, probes)), _NEEDS).join(rings, "cell")
    else:
        pairs = needed(spark, index, queries, k, lanes)
    pairs = materialise(spark, pairs.select("query_id", "embedding", "bound", "cell", "block"), "query-blocks")
    cells = [r["cell"] for r in pairs.select("cell").distinct().collect()]
    return keyed.top_per_key(_compare(spark, index, pairs, lanes, k, cells), ["query_id"], [F.col("distance"), F.col("vec_id")], k)
