"""Centroid clustering of integer vectors with DataFrame expressions.

Distances to the centroids are ``zip_with`` and ``aggregate`` over literal arrays, the nearest
one is ``array_min`` of (distance, number), and a round's new centroids are one aggregation of
column sums per cluster. What reaches the driver is k rows of fixed width a round. The integer
vectors are written once, so that a round reads no floats and has no lineage behind it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, read

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
HELD = 1 << 27  # 64 squares of a difference of 2^28 still fit a long


def integer_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<int>): floor(scale * x) of the vectors with ``dimensions`` finite components.

    Components are held within +-2^27, which only numbers from 2^21 on reach at a scale of 64.
    """
    x = F.col("embedding")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = F.transform(x, lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-HELD)), F.lit(HELD)).cast("int"))
    return embeddings.select("vec_id", "embedding").where((F.size(x) == dimensions) & usable).select("vec_id", held.alias("v"))


def squared_distance(centroid: list[int]) -> Column:
    """Squared Euclidean distance of column ``v`` to a literal centroid, as a long."""
    literal = F.array(*[F.lit(c).cast("bigint") for c in centroid])
    squares = F.zip_with("v", literal, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("bigint"), lambda total, s: total + s)


def nearest(centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; ties go to the smaller number."""
    return F.array_min(F.array(*[
        F.struct(squared_distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)
    ]))


def seeds(vectors: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """Vectors with the smallest sha256 of ``1:<vec_id>``; ties and rows without id go by the vector itself."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in vectors.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: floor of the mean of each cluster, by component; an empty cluster keeps its centroid."""
    sums = [F.sum(F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(len(centroids[0]))]
    rows = vectors.select("v", nearest(centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums)
    out = list(centroids)
    for r in rows.collect():  # one row a cluster
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return out


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<bigint>) of every usable vector.

    ``embeddings`` has vec_id and embedding; other columns are ignored. Vectors that are null,
    have another length, or a null, NaN or infinite component are left out. Repeated rows are
    vectors of their own. Fewer vectors than ``clusters`` give as many centroids as there are
    vectors; an empty table gives an empty result. Sums of distances beyond a long are null.
    """
    spark = embeddings.sparkSession
    vectors = materialise(spark, integer_vectors(embeddings, dimensions, scale), "vectors")
    centroids = seeds(vectors, clusters)
    if not centroids:
        return vectors.select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit([0]).cast("array<bigint>").alias("centroid"),
        )
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = vectors.select("vec_id", nearest(centroids).alias("near")).select(
        "vec_id", F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance")
    )
    found = materialise(spark, found, "clustered")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}

    def by_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster") + 1)

    def long_or_null(n: int) -> int | None:
        return n if n < 1 << 63 else None

    return found.select(
        "vec_id", "cluster", "distance",
        by_cluster([long_or_null(sums.get(k, 0)) for k in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(long_or_null(sum(sums.values()))).cast("bigint").alias("inertia"),
        F.element_at(F.array(*[F.lit(c).cast("array<bigint>") for c in centroids]), F.col("cluster") + 1).alias("centroid"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of ``embeddings`` with its cluster; see ``cluster``."""
    found = cluster(read(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def plain_clusters(rows: list[tuple[int | None, list[int]]], clusters: int = CLUSTERS, rounds: int = ROUNDS) -> list[tuple]:
    """The same in plain Python over (vec_id, integer vector), for tests."""

    def key(row):
        return (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest(), row[1])

    def find(v, cs):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cs))

    cs = [list(v) for _, v in sorted(rows, key=key)[:clusters]]
    for _ in range(rounds):
        members: dict[int, list] = {}
        for _, v in rows:
            members.setdefault(find(v, cs)[1], []).append(v)
        cs = [[sum(col) // len(members[k]) for col in zip(*members[k])] if k in members else c for k, c in enumerate(cs)]
    near = [(i, *find(v, cs)) for i, v in rows]
    inertia = {k: sum(d for _, d, c in near if c == k) for k in range(len(cs))}
    return [(i, k, d, inertia[k], sum(inertia.values()), cs[k]) for i, d, k in near]


def _sql() -> str:
    near = """
{name} AS (
    SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT a.rid, c.k, CAST(sum((a.x - c.x) * (a.x - c.x)) AS BIGINT) AS d FROM parts a JOIN {centroids} c USING (i) GROUP BY a.rid, c.k
    ) GROUP BY rid
)"""
    moves = """
{name} AS (
    SELECT c.k, c.i, CAST(coalesce((s - ((s % n) + n) % n) // n, c.x) AS BIGINT) AS x FROM {centroids} c LEFT JOIN (
        SELECT near.k, a.i, sum(a.x) AS s, count(*) AS n FROM parts a JOIN {near} near USING (rid) GROUP BY near.k, a.i
    ) m ON m.k = c.k AND m.i = c.i
)"""
    steps = []
    for r in range(ROUNDS):
        steps += [near.format(name=f"near{r}", centroids=f"c{r}"), moves.format(name=f"c{r + 1}", centroids=f"c{r}", near=f"near{r}")]
    steps.append(near.format(name="final", centroids=f"c{ROUNDS}"))
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMENSIONS}),
flat AS (SELECT rid, unnest(range(1, {DIMENSIONS + 1})) AS i, unnest(embedding) AS e FROM numbered),
bad AS (SELECT DISTINCT rid FROM flat WHERE e IS NULL OR NOT isfinite(e)),
parts AS (SELECT rid, i, CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) AS x FROM flat WHERE rid NOT IN (SELECT rid FROM bad)),
first AS (
    SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM numbered
    WHERE rid NOT IN (SELECT rid FROM bad) ORDER BY sha256('1:' || vec_id) LIMIT {CLUSTERS}
),
c0 AS (SELECT k, i, x FROM parts JOIN first USING (rid)),{",".join(steps)},
digests AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM final JOIN numbered USING (rid) JOIN digests USING (k)
"""


OP13_SQL = _sql()
