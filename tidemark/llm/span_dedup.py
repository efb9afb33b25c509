"""Substring dedup over words, by seed and extend.

Seeds are winnowed anchors: every window of 50 words has one anchor (a 6-gram), the same for
equal windows, and neighbouring windows mostly share theirs. A record is a run of windows of one
document with a common anchor. Documents are joined on anchors; a seed is extended both ways to
the whole run by its context hash, and where contexts differ, window by window. Windows that
were found in an earlier document are merged into maximal repeats and cut out.

No pairs of documents are listed: a group is reduced to its smallest doc_id first, equal
contexts to one representative, and only representatives of anchors with several contexts are
compared, by the hashes of their windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import winnow
from tidemark.llm.common import WORD_BYTES, materialise, read, slices, texts_of

WINDOW = 50
SEED_WORDS = 6

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WORD_BYTES)] = True


class Words:
    """The words of some texts as hashes, with the document of each."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8") for t in texts]
        data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        space = IS_SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self.hashes = winnow.word_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)
        begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
        self.first = np.searchsorted(starts, begins)  # of each document among all words
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(texts_of(batch))
        spans = winnow.Spans(words.hashes)
        grams = spans.grams(SEED_WORDS)
        a = winnow.anchors(grams, SEED_WORDS, WINDOW, words.doc)
        if not len(a.place):
            continue
        context = spans.hash(a.first, a.first + a.count - 1 + WINDOW)
        context = winnow.mixed(context + ((a.place - a.first) * 64 + a.count).astype(np.uint64))
        doc = words.doc[a.first]
        yield pa.record_batch(
            [
                batch.column("doc_id").take(pa.array(doc)), batch.column("version").take(pa.array(doc)),
                pa.array(grams[a.place].view(np.int64)), pa.array(context.view(np.int64)),
                pa.array((a.first - words.first[doc]).astype(np.int32)), pa.array(a.count.astype(np.int32)),
            ],
            names=["doc_id", "version", "anchor", "context", "at", "n"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window hashes of the runs listed in ``runs`` for each document."""
    for batch in slices(batches, "text"):
        words = Words(texts_of(batch))
        grams = winnow.Spans(words.hashes).grams(WINDOW)
        runs = batch.column("runs")
        doc = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(runs).to_numpy())
        flat = runs.flatten()
        anchor, context, at, n = (flat.field(i).to_numpy() for i in range(4))
        n = n.astype(np.int64)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(words.first[doc] + at, n) + step
        yield pa.record_batch(
            [
                pa.array(np.repeat(anchor, n)), pa.array(np.repeat(context, n)),
                batch.column("doc_id").take(pa.array(np.repeat(doc, n))),
                pa.array(step.astype(np.int32)), pa.array(grams[place].view(np.int64)),
            ],
            names=["anchor", "context", "doc_id", "step", "hash"],
        )


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, version, at, n): runs of windows that also start in a document with a smaller doc_id.

    ``at`` is the first window's first word. ``docs`` has doc_id (not null), text and version,
    which tells texts apart that share a doc_id.
    """
    spark = docs.sparkSession
    records = materialise(
        spark, docs.mapInArrow(_records, "doc_id bigint, version int, anchor bigint, context bigint, at int, n int"), "anchors"
    )
    # Seeds are written before they are joined: a join that reads two plain shuffles can be split
    # where an anchor is hot, one that continues the aggregation can't.
    seeds = materialise(
        spark,
        records.groupBy("anchor")
        .agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"), (F.min("context") == F.max("context")).alias("alike"))
        .where("lowest < highest").select("anchor", "lowest", "alike"),
        "seeds",
    )
    shared = materialise(spark, records.join(seeds, "anchor"), "shared-anchors")

    alike = shared.where("alike AND doc_id > lowest")
    varied = shared.where("NOT alike").drop("lowest")
    classes = materialise(
        spark,
        varied.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "version", "at", "n")).alias("r")).select("anchor", "context", "r.*"),
        "contexts",
    )
    lowest = classes.select("anchor", "context", F.col("doc_id").alias("lowest"))
    runs = classes.groupBy("doc_id", "version").agg(F.collect_set(F.struct("anchor", "context", "at", "n")).alias("runs"))
    windows = materialise(
        spark,
        docs.join(runs, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]).select("doc_id", "text", "runs")
        .mapInArrow(_windows, "anchor bigint, context bigint, doc_id bigint, step int, hash bigint"),
        "windows",
    )
    earliest = materialise(
        spark,
        windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"))
        .where("lowest < highest").drop("highest"),
        "earliest-windows",
    )
    found = (
        windows.join(earliest, ["anchor", "hash"]).where("lowest < doc_id")
        .groupBy("anchor", "context").agg(F.collect_set("step").alias("steps"))
    )
    own = varied.join(lowest, ["anchor", "context"])
    later = own.where("doc_id > lowest")
    first = own.where("doc_id = lowest").join(found, ["anchor", "context"])
    columns = ["doc_id", "version", "at", "n"]
    return (
        alike.select(*columns).union(later.select(*columns))
        .union(
            first.select("doc_id", "version", "at", F.explode("steps").alias("step"))
            .select("doc_id", "version", (F.col("at") + F.col("step")).alias("at"), F.lit(1).alias("n"))
        )
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for text, spans in zip(texts_of(batch), batch.column("spans").to_pylist()):
            words = text.encode("utf-8").split()
            removed = np.zeros(len(words) + 1, np.int64)
            for s in spans or ():
                removed[s["at"]] += 1
                removed[s["at"] + s["n"] - 1 + WINDOW] -= 1
            gone = (np.cumsum(removed[:-1]) > 0).tolist() if spans else []
            kept = [w for w, g in zip(words, gone) if not g] if spans else words
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8")))
        n, cut, kept = zip(*rows)
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def dedup_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, joined by one space) for every row.

    A word goes if a window of 50 consecutive words covers it whose word sequence also starts
    in a row with a smaller doc_id. Null text has no words. Rows with a null doc_id stay whole
    and remove nothing. Repeated rows don't remove each other (their doc_ids are equal) and come
    back as often as they occur; texts that share a doc_id are cut each by its own repeats.
    Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("version", F.hash("text"))
    found = repeats(docs.where(F.col("doc_id").isNotNull()))
    spans = found.groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "n")).alias("spans"))  # rows that repeat have the same
    return (
        docs.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans")
        .mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    )


def op3_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


OP3_SQL = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\x0B\f]+') AS ws FROM documents
), words AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split
), windows AS (
    SELECT doc_id, p AS i, array_to_string(list_slice(ws, p, p + 49), ' ') AS w
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM split WHERE len(ws) >= 50)
), lowest AS (
    SELECT w, min(doc_id) AS lowest FROM windows GROUP BY w
), found AS (
    SELECT DISTINCT doc_id, i FROM windows JOIN lowest USING (w) WHERE lowest < doc_id
), marked AS (
    SELECT words.doc_id, words.i, word, coalesce(max(CASE WHEN found.i IS NOT NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM words LEFT JOIN found ON words.doc_id = found.doc_id AND words.i = found.i
), kept AS (
    SELECT doc_id, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept
    FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
