"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits meet half way: the 64 bits are seen through
four masks that hide one block of 16 bits each, and under every mask a fingerprint emits itself
and all variants with one more bit flipped (half the radius, rounded down). One of the differing
bits always lies in some hidden block; of the others each side flips one, so both emit the same
variant. Variants are shuffled; fingerprints that share one are verified and linked.

A variant is shared by at most 49 x 65,536 fingerprints, whatever the size of the corpus. Inside
such a group no pairs are listed: what may differ is enumerated bit pattern by bit pattern, and
the group passes on one edge per fingerprint (to the smallest one it is connected with).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, read, slices, texts_of, whole_row
from tidemark.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = [(16 * j, 0xFFFF << (16 * j)) for j in range(4)]
DEALT_PRINTS = 1 << 17  # fingerprints of a task that emits variants: 196 rows each
SMALL_GROUP = 48  # up to here all pairs of a group are compared in memory


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str, digest) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    k = min(SHINGLE, len(words))
    ends = ends[k - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64).astype(">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in slices(batches, "text"):
        prints = [_signed(fingerprint(t, xxhash.xxh64_intdigest)) for t in texts_of(batch)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("version"), pa.array(prints, pa.int64())], names=["doc_id", "version", "fp"])


def variants(prints: DataFrame) -> DataFrame:
    """(block, key, fp): each fingerprint under each mask, alone and with one visible bit flipped."""
    keys = []
    for j, (_, hidden) in enumerate(BLOCKS):
        seen = F.col("fp").bitwiseAND(F.lit(_signed(~hidden & (2**64 - 1))))
        flips = [0, *(1 << b for b in range(64) if not hidden >> b & 1)]
        keys += [F.struct(F.lit(j).cast("tinyint").alias("block"), seen.bitwiseXOR(F.lit(_signed(f))).alias("key")) for f in flips]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.block", "k.key", "fp")


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of every edge (a, b), and all that carry their labels, the smaller label."""
    while True:
        left, right = labels[a], labels[b]
        if (left == right).all():
            return
        np.minimum.at(labels, np.maximum(left, right), np.minimum(left, right))
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def group_roots(block: int, key: int, members: np.ndarray) -> np.ndarray:
    """For sorted distinct ``members`` (uint64) that share a variant: index of the smallest one connected with each."""
    m = len(members)
    labels = np.arange(m)
    if m <= SMALL_GROUP:
        a, b = np.triu_indices(m, 1)
        near = np.bitwise_count(members[a] ^ members[b]) <= RADIUS
        _settle(labels, a[near], b[near])
        return labels
    shift, hidden = BLOCKS[block]
    inner = ((members & np.uint64(hidden)) >> np.uint64(shift)).astype(np.int64)
    outer = members & np.uint64(~hidden & (2**64 - 1))
    flipped = outer ^ np.uint64(key)  # zero or one bit
    kind = np.where(flipped == 0, 0, 1 + np.log2(np.maximum(flipped, 1).astype(float)).astype(np.int64))
    code = kind << 16 | inner
    order = np.argsort(code)
    sorted_code = code[order]
    plain = int(np.searchsorted(sorted_code, 1 << 16))  # members whose visible bits are the variant's
    value, first = np.unique(inner, return_index=True)

    def link(where: np.ndarray, wanted: np.ndarray, table: np.ndarray, index: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        hit = table[at] == wanted
        _settle(labels, where[hit], index[at[hit]])

    every = np.arange(m)
    for n in range(RADIUS + 1):
        for bits in combinations(range(16), n):
            pattern = sum(1 << b for b in bits)
            if n <= 1:  # at most two visible bits differ: near enough whatever the kinds
                link(every, inner ^ pattern, value, first)
            else:
                link(every, code ^ pattern, sorted_code, order)
                if n == 2 and plain:  # one visible bit differs from the members that are the variant itself
                    link(every, inner ^ pattern, sorted_code[:plain], order)
    return labels


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows sorted by (block, key, fp); a group may go on in the next batch."""

    def edges(block: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        u, v = [], []
        pairs = starts[sizes == 2]
        if len(pairs):
            near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= RADIUS]
            u.append(fp[near + 1])
            v.append(fp[near])
        for i, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            members = np.sort(fp[i : i + n])
            roots = group_roots(int(block[i]), int(key[i]), members)
            joined = roots != np.arange(n)
            u.append(members[joined])
            v.append(members[roots[joined]])
        if u:
            yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().view(np.uint64)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        last = np.flatnonzero((now[1] != now[1][-1]) | (now[0] != now[0][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from edges(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield from edges(*held)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (bigint), component_id, root, version for every row of ``docs`` (doc_id, text, anything else).

    component_id is the smallest doc_id among all rows whose fingerprints are connected by links
    of at most three differing bits. Null text counts as empty; empty and wordless texts have
    fingerprint zero and are linked like any other. root is the smallest fingerprint of the
    component, version the hash of the text. Rows with a null doc_id take part, but never
    give a component its id (which is null if it has no other row). Repeated rows come back as
    often as they occur; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = materialise(
        spark,
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
        .mapInArrow(_fingerprints, "doc_id bigint, version bigint, fp bigint"),
        "fingerprints",
    )
    distinct = materialise(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    # Fingerprints are few bytes, their variants 196 times as many: tasks are dealt by the latter.
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(distinct.count() / DEALT_PRINTS))
    edges = (
        variants(distinct.select("fp").repartition(tasks, "fp")).repartition("block", "key").sortWithinPartitions("block", "key", "fp")
        .mapInArrow(_links, "u bigint, v bigint")
    )
    roots = connected_components(edges)
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    classes = materialise(spark, classes, "fingerprint-classes")
    names = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(names, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root", "version")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each component.

    The row with the smallest doc_id stays (rows without one only where there is no other), the
    smallest hash of the text breaks ties, and of repeated rows one stays.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version"))
    keep = (
        near_duplicates(docs).groupBy("root").agg(best.alias("best"))
        .select(F.col("best.doc_id").alias("keep_id"), F.col("best.version").alias("keep_version"))
    )
    rows = docs.select(
        whole_row(docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("version")
    )
    rows = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("version") == F.col("keep_version")))
    return rows.dropDuplicates(["keep_id", "keep_version"]).select("row.*")


def hex_print(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op6_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", hex_print().alias("fingerprint"), "component_id")
