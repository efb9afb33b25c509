"""Back-fill of vectors in batches of fixed size, with a ledger of the batches that are done."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import keyed

BATCH_ROWS = 200
LEDGER = "batch bigint, n_rows bigint, run int"
RESULTS = "batch bigint, record_id bigint, embedding array<double>, error string"


def in_batches(backlog: DataFrame, size: int = BATCH_ROWS) -> DataFrame:
    """``backlog`` (record_id, text) with a batch number: full batches in order of record_id, numbered from 0."""
    placed = keyed.numbered(backlog, [F.col("record_id")], "_place")
    return placed.withColumn("batch", F.call_function("div", F.col("_place") - 1, F.lit(size))).drop("_place")


def plan(backlog: DataFrame, path: str, size: int = BATCH_ROWS) -> None:
    """Writes the batches once, so that a rerun finds the same ones."""
    in_batches(backlog, size).write.parquet(f"{path}/plan")
    backlog.sparkSession.createDataFrame([], LEDGER).write.parquet(f"{path}/ledger")


def pending(spark: SparkSession, path: str) -> DataFrame:
    """Planned rows of batches that the ledger doesn't have."""
    done = spark.read.schema(LEDGER).parquet(f"{path}/ledger").select("batch").distinct()
    return spark.read.parquet(f"{path}/plan").join(done, "batch", "left_anti")


def _guarded(embed: Callable[[list[str]], list[list[float]]]):
    """One call of the model per batch; a batch that raises has one row with the error and no vector."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("record_id")
        batch = int(rows["batch"].iloc[0])
        try:
            vectors = [[float(x) for x in v] for v in embed(rows["text"].tolist())]
            if len(vectors) != len(rows):
                raise ValueError(f"{len(vectors)} vectors for {len(rows)} texts")
        except Exception as e:  # noqa: BLE001 - whatever the model raises fails its batch only
            return pd.DataFrame({"batch": [batch], "record_id": [None], "embedding": [None], "error": [f"{type(e).__name__}: {e}"]})
        return pd.DataFrame({"batch": batch, "record_id": rows["record_id"], "embedding": vectors, "error": None})

    return run


def run_pending(spark: SparkSession, path: str, run: int, embed: Callable[[list[str]], list[list[float]]]) -> None:
    """Runs the model on every pending batch; results go to ``path/results``, finished batches into the ledger.

    A run that was lost before its batches reached the ledger is repeated and overwrites its own
    results; one that the ledger has is refused.
    """
    if spark.read.schema(LEDGER).parquet(f"{path}/ledger").where(F.col("run") == run).head(1):
        raise ValueError(f"run {run} is done")
    target = f"{path}/results/run={run}"
    out = pending(spark, path).groupBy("batch").applyInPandas(_guarded(embed), RESULTS)
    out.write.mode("overwrite").parquet(target)
    done = spark.read.schema(RESULTS).parquet(target).where(F.col("error").isNull()).groupBy("batch").agg(F.count("*").alias("n_rows"))
    done.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/ledger")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """batch, record_id, embedding, run of everything finished."""
    found = spark.read.schema(f"{RESULTS}, run int").parquet(f"{path}/results")
    done = spark.read.schema(LEDGER).parquet(f"{path}/ledger").select("batch", "run").distinct()
    return found.where(F.col("error").isNull()).join(done, ["batch", "run"], "left_semi").drop("error")
