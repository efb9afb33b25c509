"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute available)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import fresh_path, materialise  # noqa: F401  (re-used by the operators)

WORD_BYTES = b" \t\n\r\x0b\x0c"  # what separates words in every contract: \x20 and \x09-\x0D
SLICE_BYTES = 1_000_000  # text that a Python process works on at a time


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str):
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(columns: list[str]):
    """All given columns as one struct, so that helper columns beside it can't clash with them."""
    return F.struct(*[named(c) for c in columns])


def release_memory() -> None:
    """Hand freed memory back to the system, so that idle Python processes stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes at a time (one row at least)."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)
    release_memory()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def held_out(doc_id: str = "doc_id"):
    """True for rows whose crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def single_labels(labels: DataFrame, label: str) -> DataFrame:
    """One 0/1 label per id: null ids and labels are left out, repeated rows vote, ties count as 1."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    )


def hash_sample(df: DataFrame, id_column: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by the hash of their id; all of them if there are no more."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 20)) < int((1 << 20) * rows / n))


def heaviest(df: DataFrame, weight: str, rows: int) -> DataFrame:
    """The rows of largest positive weight, ``rows`` of them at most.

    Weights are cut into classes a sixteenth of an octave wide; the highest classes that fit
    together are kept whole. Only the class sizes reach the driver. ``df`` is read twice.
    """
    step = F.floor(F.log2(weight) * 16)
    sizes = {r["step"]: r["n"] for r in df.where(F.col(weight) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    least, held = None, 0
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > rows:
            break
        least, held = k, held + sizes[k]
    return df.where((F.col(weight) > 0) & (step >= least)) if least is not None else df.limit(0)
