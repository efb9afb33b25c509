"""Budget by running cost, batches with a ledger, profiles from footers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backfill, keyed
from tidemark.operators import upkeep as U
from tidemark.session import fresh_path


def test_budget_equals_greedy_run(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, 1.0, 2.0, rnd.random()])) for i in range(100_000)]
    sources = spark.createDataFrame(rows, "source_code bigint, reputation double").repartition(5)
    got = {r.source_code: r.decision for r in U.crawl_budget(sources, 0.25, 9_000.5).collect()}
    spent, want = 0.0, {}
    for code, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0])):
        fits = spent + 0.25 <= 9_000.5
        spent += 0.25 * fits
        want[code] = "CRAWL" if fits else "DEFER"
    assert got == want


def test_budget_has_no_global_step(spark):
    sources = spark.createDataFrame([(i, float(i)) for i in range(50)], "source_code bigint, reputation double")
    plan = U.crawl_budget(sources, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan


@pytest.mark.parametrize("n", [0, 1, 37])
def test_positions_are_dense(spark, n):
    rows = spark.range(n).withColumn("k", F.col("id") % 5).repartition(3)
    got = [tuple(r) for r in keyed.numbered(rows, [F.col("k").desc(), F.col("id")], "place").orderBy("place").collect()]
    assert got == [(i, k, p) for p, (k, i) in enumerate(sorted(((i % 5, i) for i in range(n)), key=lambda x: (-x[0], x[1])), 1)]


def test_only_failed_batches_are_done_again(spark):
    path = fresh_path(spark, "backfill")
    backlog = spark.createDataFrame([(i, f"text {i}") for i in range(45)], "record_id bigint, text string")
    backfill.plan(backlog, path, 10)
    marks = fresh_path(spark, "calls").removeprefix("file:")
    os.makedirs(marks)

    def model(broken):
        def embed(texts):
            open(f"{marks}/{broken}-{texts[0].split()[1]}", "w").close()
            if texts[0] in broken:
                raise TimeoutError("no answer")
            return [[float(len(t))] for t in texts[:-1] if broken] if texts[0] == "text 30" and broken else [[float(len(t))] for t in texts]

        return embed

    backfill.run_pending(spark, path, 0, model(("text 10",)))
    assert backfill.vectors(spark, path).count() == 25  # one batch raised, one got too few vectors
    assert {r.batch for r in backfill.pending(spark, path).select("batch").distinct().collect()} == {1, 3}
    backfill.run_pending(spark, path, 1, model(()))
    done = sorted((r.record_id, r.batch, r.run) for r in backfill.vectors(spark, path).collect())
    assert done == [(i, i // 10, 1 if i // 10 in (1, 3) else 0) for i in range(45)]
    assert sorted(f.split("-")[1] for f in os.listdir(marks) if f.startswith("()")) == ["10", "30"]
    assert backfill.pending(spark, path).count() == 0
    with pytest.raises(ValueError):
        backfill.run_pending(spark, path, 1, model(()))


def test_profile_comes_from_footers(spark):
    path = fresh_path(spark, "profiled")
    spark.range(1000).selectExpr("id", "id % 3 AS part").write.partitionBy("part").parquet(path)
    got = U.profile(spark, {"a": path}).head()
    local = path.removeprefix("file:")
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(local) for f in fs if f.endswith(".parquet"))
    assert (got.n_rows, got.n_bytes) == (1000, size)
    with U.from_footers(spark):
        plan = U.counted(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert spark.conf.get(U.V1_SOURCES) == "avro,csv,json,kafka,orc,parquet,text"
