"""Quality scores from boosted trees over document statistics.

Statistics come from the text alone. They are computed once and written to the shared folder;
the trees are fitted on a bounded sample of labelled rows (TRAIN_ROWS) and sent to the tasks as
arrays of a few kilobytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import boosted_trees
from tidemark.llm.common import hash_sample, held_out, materialise, read, single_labels, slices, texts_of

TRAIN_ROWS = 50_000  # labelled rows that the trees are fitted on, at most
CUTOFF = 0.3
SYMBOL_BYTES = np.frombuffer(b"#*$%&|<>~^_=+@\\/{}[]", np.uint8)
MARK_BYTES = np.frombuffer(b".,;:?", np.uint8)


def statistics(text: str, compress) -> list[float]:
    """The numbers a text is judged by; all zero for an empty text."""
    raw = text.encode("utf-8")
    words = raw.split()
    if not words:
        return [float(len(raw) > 0), *[0.0] * (N_STATISTICS - 1)]
    n, size = len(words), len(raw)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = histogram[65:91].sum() + histogram[97:123].sum()
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    triples = set(zip(words, words[1:], words[2:]))
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        1.0,
        float(np.log1p(size)),
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths <= 3).mean()),
        float(histogram[SYMBOL_BYTES].sum() / n),
        float(histogram[MARK_BYTES].sum() / n),
        float(histogram[33] / n),
        float(histogram[48:58].sum() / size),
        float(histogram[65:91].sum() / max(letters, 1)),
        float(histogram[128:].sum() / size),
        len(counts) / n,
        max(counts.values()) / n,
        len(triples) / max(n - 2, 1),
        len(set(lines)) / len(lines),
        float(np.log1p(size / len(lines))),
        size / len(compress(raw)),
    ]


N_STATISTICS = 18


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches, "text"):
        rows = [statistics(t, compress) for t in texts_of(batch)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _score(forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, N_STATISTICS)
            yield pa.record_batch([batch.column("doc_id"), pa.array(forest.value.score(x))], names=["doc_id", "score"])

    return run


def fit_forest(measured: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS):
    """Trees fitted to the labelled rows outside the held-out fold, about ``train_rows`` of them at most, by hash."""
    known = hash_sample(single_labels(labels, label).where(~held_out("label_id")), "label_id", train_rows)
    rows = measured.join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "x", "label").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(-1, N_STATISTICS)
    return boosted_trees.fit(x, rows["label"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels (doc_id, quality).

    Null text is scored as empty. A null doc_id is scored, counts as not held out and is never
    trained on. Repeated rows come back as often as they occur (and count as often in training);
    repeated labels vote, ties count as 1; null labels are left out. Without both labels every
    score is the same (0.5 without any). Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    measured = materialise(
        spark,
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .mapInArrow(_statistics, "doc_id bigint, x array<double>"),
        "text-statistics",
    )
    forest = spark.sparkContext.broadcast(fit_forest(measured, labels, train_rows=train_rows))
    return (
        measured.mapInArrow(_score(forest), "doc_id bigint, score double")
        .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
    )


def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
