"""Vector search through the pivot index against brute force."""

import numpy as np
import pytest

from tidemark.operators import search, vector_index


def brute(rows, queries, k):
    out = {}
    for query_id, target in queries:
        gaps = sorted((float(np.floor(np.sqrt(((np.array(v) - np.array(target)) ** 2).sum()) * 1e6 + 0.5) / 1e6), i) for i, v in rows)
        out[query_id] = gaps[:k]
    return out


def clustered(n, width, groups, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-1, 1, (groups, width))
    return [(i, (centres[i % groups] + rng.normal(0, spread, width)).tolist()) for i in range(n)]


def frames(spark, rows, queries):
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    return vectors, spark.createDataFrame(queries, "query_id bigint, embedding array<double>")


def answers(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    return out


@pytest.mark.parametrize("n, width, groups, spread", [(700, 6, 20, 0.05), (400, 16, 3, 1.0), (60, 4, 1, 0.0)])
def test_pruned_search_is_exact(spark, monkeypatch, n, width, groups, spread):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 4)
    rows = clustered(n, width, groups, 1, spread)
    rows += [(10_000 + i, rows[5][1]) for i in range(40)]  # a group of equal vectors, more than a block
    queries = clustered(13, width, groups, 1, spread) + [(99, rows[5][1]), (98, [50.0] * width)]
    vectors, asked = frames(spark, rows, queries)
    assert answers(search.nearest(vectors, asked, 7)) == brute(rows, queries, 7)


def test_most_cells_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 16)
    rows, queries = clustered(2000, 8, 40, 2), clustered(3, 8, 40, 2)
    vectors, asked = frames(spark, rows, queries)
    index = vector_index.build(vectors)
    pairs = vector_index.needed(spark, index, asked, 6, 1)
    stored = vector_index.blocks(spark, index.path)
    assert stored.agg({"n": "sum"}).head()[0] == 2000
    assert pairs.select("cell").distinct().count() * 4 < stored.select("cell").distinct().count()
    assert pairs.count() * 4 < stored.count() * len(queries)
    found = vector_index.search(spark, index, asked, 6)
    assert answers(found) == brute(rows, queries, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1][:200]


def test_probing_few_cells_has_recall(spark):
    rows, queries = clustered(1500, 12, 25, 3, 0.2), clustered(40, 12, 25, 4, 0.2)
    vectors, asked = frames(spark, rows, queries)
    index = vector_index.build(vectors)
    exact, near = answers(vector_index.search(spark, index, asked, 10)), answers(vector_index.search(spark, index, asked, 10, probes=len(index.pivots) // 3))
    hit = sum(len({i for _, i in exact[q]} & {i for _, i in near[q]}) for q in exact)
    assert hit >= 0.9 * 10 * len(queries)


def test_odd_vectors_and_queries(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0])]
    queries = [(1, [1.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0])]
    vectors, asked = frames(spark, rows, queries)
    assert answers(search.nearest(vectors.where("vec_id <> 4"), asked, 2)) == {1: [(0.0, 2), (0.0, 5)]}
    assert search.nearest(vectors.where("vec_id = 3"), asked, 2).count() == 0
    assert search.nearest(vectors.where("vec_id <> 4"), asked.limit(0), 2).count() == 0
    assert len(answers(search.nearest(vectors.where("vec_id <> 4"), asked, 9))[1]) == 3
