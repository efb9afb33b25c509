"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (runs of ASCII white space become one
space, which no tokenizer of this kind tells apart) together with the digest of the tokenizer
version. Counts are looked up in a Parquet cache; only distinct keys that miss are encoded,
and what was encoded is appended to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordbpe
from tidemark.llm.common import fresh_path, read, slices, texts_of

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"
MEMO_WORDS = 300_000  # words whose counts one Python process remembers at a time
TOKEN_LIMIT = 2048


class _PieceCounts(dict):
    """Count of tokens by piece; pieces not seen yet go to the library's model."""

    def __init__(self, bpe: wordbpe.WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        symbols = self.bpe.symbols
        n = self[piece] = len(self.bpe.library.model.tokenize("".join(symbols[b] for b in piece.encode("utf-8"))))
        return n


def _count(tokenizer_path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(tokenizer_path)
        known = _PieceCounts(bpe)
        for batch in slices(batches, "text"):
            counts = []
            for text in texts_of(batch):
                pieces = bpe.words(text)
                counts.append(len(bpe.encode(text)) if pieces is None else sum(map(known.__getitem__, pieces)))
            yield pa.record_batch(
                [batch.column("content"), pa.array([version] * len(counts)), pa.array(counts, pa.int64())],
                names=["content", "tokenizer", "n_tokens"],
            )

    return run


def cached(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """content -> n_tokens of one tokenizer version; empty if there is no cache yet."""
    try:
        frame = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        frame = spark.createDataFrame([], CACHE_SCHEMA)
    return frame.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, cache_path: str, tokenizer_path: str | None = None, token_limit: int = TOKEN_LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text, anything else).

    Null text counts as empty (0 bytes, 0 tokens). A null doc_id is kept as it is. Repeated
    rows come back as often as they occur. Other columns are ignored. An empty table gives an
    empty result and leaves the cache unchanged. One occurrence of each missing content is
    encoded: the one with the smallest doc_id, found by a pre-aggregated minimum, so that a text
    with very many copies moves once.
    """
    spark = docs.sparkSession
    path = tokenizer_path or wordbpe.default_path()
    version = wordbpe.version_digest(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.unhex(F.sha2(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "), 256))
    rows = docs.select("doc_id", content.alias("content"), F.octet_length(text).cast("bigint").alias("n_bytes"))

    missing = (
        rows.groupBy("content").agg(F.min("doc_id").alias("first_id"))
        .join(cached(spark, cache_path, version), "content", "left_anti")
        .withColumnRenamed("content", "wanted")
    )
    todo = (
        docs.select("doc_id", content.alias("content"), text.alias("text"))
        .join(missing, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("content") == F.col("wanted")))
        .select("content", "text")
    )
    # Rows that repeat both id and text are encoded once each; the cache reads them as one.
    todo.mapInArrow(_count(path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    return (
        rows.join(cached(spark, cache_path, version), "content", "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_limit).alias("over_limit"))
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), fresh_path(spark, "token-cache"))
