"""Suffix-array dedup over bytes, by a distributed merge sort that uses common prefixes.

Of all suffixes only those at content-defined anchors are sorted: every window of 100 bytes has
one anchor, the same for equal windows, so equal windows are found through suffixes that start
at their anchors. The steps:

1. Texts are packed into compressed blocks of about one megabyte, written once. Only blocks,
   anchor hashes and suffixes are shuffled afterwards.
2. Distinguishing prefixes: blocks ask, by 32-bit hashes of the first 20 bytes, which of their
   anchors occur elsewhere. Other suffixes are told apart within those bytes and need no sorting.
3. Each task sorts its remaining suffixes (cut where no window reaches), front-codes them and
   sends each range of the order to one reducer as one compressed run. Suffixes with equal
   surroundings are reduced to the earliest in a task before.
4. Reducers combine runs with a loser tree that never compares a known prefix again. The shared
   lengths it puts out delimit which suffixes agree how far; windows are equal if the suffixes
   agree behind the anchor and their bytes in front of it are equal.
5. Windows that also start earlier go back to their blocks, and their bytes are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lcp_merge, winnow
from tidemark.llm.common import materialise, read, release_memory, slices

WINDOW = 100
SEED_BYTES = 20
BLOCK_BYTES = 1_000_000
RUN_RECORDS = 200_000  # suffixes that a task collects before it sorts and sends them
MASK_32 = np.uint64(0xFFFFFFFF)


def _zstd():
    import zstandard

    return zstandard


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    partition, n = TaskContext.get().partitionId(), 0
    for batch in slices(batches, "text", BLOCK_BYTES):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.record_batch(
            [pa.array([(partition << 32) + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            names=["block", "packed"],
        )
        n += 1


class Block:
    """The rows of a block, their bytes in one array, and their anchors in order of hash."""

    def __init__(self, packed: bytes, find: bool = True):
        self.batch = pa.ipc.open_stream(packed).read_all().combine_chunks().to_batches()[0]
        text = self.batch.column("text")
        buffers = text.buffers()
        wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
        self.starts = np.frombuffer(buffers[1], wide, len(text) + 1).astype(np.int64)
        self.data = np.frombuffer(buffers[2] or b"", np.uint8)[: self.starts[-1]]
        if not find:
            return
        self.ids = pa.compute.fill_null(self.batch.column("doc_id"), 0).to_numpy()
        known = self.batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(text)), np.diff(self.starts))
        self.spans = winnow.Spans(self.data.astype(np.uint64) + np.uint64(1))
        grams = self.spans.grams(SEED_BYTES)
        a = winnow.anchors(grams, SEED_BYTES, WINDOW, row)
        row = row[a.first]
        use = np.flatnonzero(known[row])
        # Anchors have the smallest hashes of their windows; mixed again, they spread over all buckets.
        spread = winnow.mixed(grams[a.place] + np.uint64(1))
        use = use[np.argsort(spread[use], kind="stable")]
        self.hash, self.row = spread[use], row[use]
        self.place, self.first, self.count = a.place[use], a.first[use], a.count[use]

    def cuts(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets that the anchors fall into, and where in their order each one begins (and the last ends)."""
        bucket = ((self.hash >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        return bucket[begin], np.concatenate([begin, [len(bucket)]])


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed in zip(batch.column("block").to_pylist(), batch.column("packed")):
                block = Block(packed.as_buffer())
                bucket, cut = block.cuts(buckets)
                low = (block.hash & MASK_32).astype(np.uint32)
                yield pa.record_batch(
                    [
                        pa.array(bucket), pa.array(np.full(len(bucket), number, np.int64)),
                        pa.array([low[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    ],
                    names=["bucket", "block", "hashes"],
                )
        release_memory()

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each value of the first column, from batches sorted by it."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row)
    if rows:
        yield key, rows


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _by_key(batches):
        parts = [np.frombuffer(r[2], np.uint32) for r in rows]
        _, where, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        again = counts[where] > 1
        answers = []
        for r, bits in zip(rows, np.split(again, np.cumsum([len(p) for p in parts])[:-1])):
            if bits.any():
                answers.append((r[1], bucket, np.packbits(bits).tobytes()))
        if answers:
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*answers), (pa.int64(), pa.int64(), pa.binary()))],
                names=["block", "bucket", "bits"],
            )


ROUTED = "part int, block bigint, row int, at int, n int, run binary"
ROUTED_NAMES = ["part", "block", "row", "at", "n", "run"]


def _routed(part, block, row, at, n, run=None) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    columns = [pa.array(np.asarray(c), type=k) for c, k in zip((part, block, row, at, n), kinds)]
    return pa.record_batch([*columns, pa.array(run if run is not None else [None] * len(columns[0]), pa.binary())], names=ROUTED_NAMES)


class _Collected:
    """Suffixes of one or more blocks on their way to a run."""

    def __init__(self):
        self.fields: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, **fields: np.ndarray) -> None:
        for name, values in fields.items():
            self.fields.setdefault(name, []).append(values)
        self.size += len(fields["id"])

    def runs(self, splitters: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(range, front-coded run) for each range of the order that has suffixes."""
        f = {name: np.concatenate(parts) for name, parts in self.fields.items()}
        right, left = f.pop("right"), f.pop("left")
        sized = np.concatenate([right, f["after"][:, None].astype(np.uint8)], axis=1)
        order = np.argsort(np.ascontiguousarray(sized).view(f"V{WINDOW + 1}").ravel(), kind="stable")
        right, left = right[order], left[order]
        f = {name: values[order] for name, values in f.items()}
        shared = lcp_merge.shared_lengths(right, f["after"])
        part = np.searchsorted(splitters, _prefix(right), "right")
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        shared[begin] = 0
        column = np.arange(WINDOW)[None, :]
        for a, b in zip(begin, [*begin[1:], len(part)]):
            s = slice(a, b)
            tails = right[s][(column >= shared[s][:, None]) & (column < f["after"][s][:, None])]
            fronts = left[s][column < f["before"][s][:, None]]
            pieces = [
                np.array([b - a], np.int64), f["id"][s].astype(np.int64), f["block"][s].astype(np.int64),
                f["row"][s].astype(np.int32), f["at"][s].astype(np.int32), f["before"][s].astype(np.uint8),
                f["after"][s].astype(np.uint8), shared[s].astype(np.uint8), tails, fronts,
            ]
            yield int(part[a]), _zstd().compress(b"".join(p.tobytes() for p in pieces), 3)


class _Run:
    """A run taken apart."""

    def __init__(self, packed: bytes):
        raw = _zstd().decompress(packed)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        at = 8

        def take(kind, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.id, self.block = take(np.int64, n).tolist(), take(np.int64, n).tolist()
        self.row, self.at = take(np.int32, n).tolist(), take(np.int32, n).tolist()
        before, after, shared = take(np.uint8, n), take(np.uint8, n), take(np.uint8, n)
        rest = after.astype(np.int64) - shared
        ends = at + np.cumsum(rest)
        tails = [raw[a:b] for a, b in zip((ends - rest).tolist(), ends.tolist())]
        at = int(ends[-1])
        ends = at + np.cumsum(before, dtype=np.int64)
        self.left = [raw[a:b] for a, b in zip((ends - before).tolist(), ends.tolist())]
        self.shared = shared.tolist()
        self.right = lcp_merge.unfold(self.shared, tails)


def _prefix(right: np.ndarray) -> np.ndarray:
    """The first eight bytes as numbers of the same order."""
    return np.ascontiguousarray(right[:, :8]).view(">u8").ravel().astype(np.uint64)


def _send(buckets: int, splitters):
    """Runs of suffixes, and windows already known to start earlier, from blocks with their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = splitters.value
        ranges = len(bounds) + 1
        collected = _Collected()
        column = np.arange(WINDOW)[None, :]

        def sent() -> Iterator[pa.RecordBatch]:
            if collected.size:
                part, packed = zip(*collected.runs(bounds))
                zeros = np.zeros(len(part), np.int64)
                yield _routed(part, zeros, zeros, zeros, zeros, packed)

        for batch in batches:
            for number, packed, answers in zip(batch.column("block").to_pylist(), batch.column("packed"), batch.column("answers").to_pylist()):
                block = Block(packed.as_buffer())
                keys, cut = block.cuts(buckets)
                again = np.zeros(len(block.hash), bool)
                where = {int(k): i for i, k in enumerate(keys)}
                for answer in answers:
                    i = where[answer["bucket"]]
                    size = cut[i + 1] - cut[i]
                    again[cut[i] : cut[i + 1]] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=size)
                use = np.flatnonzero(again)
                row, place, first, count = block.row[use], block.place[use], block.first[use], block.count[use]
                ids = block.ids[row]
                at = first - block.starts[row]
                before, end = place - first, first + count - 1 + WINDOW
                around = winnow.mixed(block.spans.hash(first, end) + (before * 256 + count).astype(np.uint64))
                # Of equal surroundings the earliest is sent; the others' windows all start earlier, namely there.
                order = np.lexsort((at, ids, around))
                new = np.concatenate([[True], around[order][1:] != around[order][:-1]]) if len(order) else np.zeros(0, bool)
                leader = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
                later = (ids[order] > ids[leader]) | (at[order] > at[leader])
                gone, keep = order[later], order[~later]
                if len(gone):
                    spread = winnow.mixed(row[gone].astype(np.uint64) + (np.uint64(number) << np.uint64(20))) % np.uint64(ranges)
                    yield _routed(spread.astype(np.int32), np.full(len(gone), number), row[gone], at[gone], count[gone])
                if len(keep):
                    limit = len(block.data) - 1
                    after = (end - place)[keep]
                    right = block.data[np.minimum(place[keep][:, None] + column, limit)]
                    left = block.data[np.minimum(first[keep][:, None] + column, limit)]
                    right[column >= after[:, None]] = 0
                    collected.add(
                        right=right, left=left, id=ids[keep], block=np.full(len(keep), number, np.int64), row=row[keep],
                        at=at[keep], before=before[keep], after=after,
                    )
                if collected.size >= RUN_RECORDS:
                    yield from sent()
                    collected = _Collected()
        yield from sent()
        release_memory()

    return run


def _spans(steps: list[int]) -> Iterator[tuple[int, int]]:
    """(first, count) of each run of consecutive numbers."""
    begin = last = None
    for s in steps:
        if last is None or s != last + 1:
            if last is not None:
                yield begin, last - begin + 1
            begin = s
        last = s
    if last is not None:
        yield begin, last - begin + 1


def resolve(group: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """(block, row, at, n) of windows that start earlier, from suffixes that begin with the same seed.

    ``group`` holds (right, left, id, at, block, row, shared) in sorted order; ``shared`` is the
    number of bytes that ``right`` shares with the one before.
    """
    leaders: dict[tuple[bytes, bytes], list] = {}
    entries, low = [], WINDOW
    for right, left, doc, at, block, row, shared in group:
        low = min(low, shared)
        entry = leaders.get((right, left))
        if entry is None:
            entry = leaders[right, left] = [doc, at, [(doc, at, block, row)], right, left, low]
            entries.append(entry)
            low = WINDOW
        else:
            entry[2].append((doc, at, block, row))
            if (doc, at) < (entry[0], entry[1]):
                entry[0], entry[1] = doc, at
    for doc, at, members, right, left, _ in entries:
        n = len(left) + len(right) - WINDOW + 1
        for d, a, block, row in members if len(members) > 1 else ():
            if (d, a) > (doc, at):
                yield block, row, a, n
    if len(entries) == 1:
        return
    # since[d]: the first entry of those, up to the present one, that agree on d bytes behind the anchor
    since = [0] * (WINDOW + 1)
    earliest: dict[tuple[int, bytes], tuple[int, int]] = {}
    listed = []
    for i, (doc, at, members, right, left, shared) in enumerate(entries):
        if i:
            since[shared + 1 :] = [i] * (WINDOW - shared)
        reach = max(shared if i else 0, entries[i + 1][5] if i + 1 < len(entries) else 0)
        need = WINDOW - len(left)  # bytes behind the anchor in the first window
        keys = []
        for j in range(min(len(right) - need, reach - need) + 1):
            key = (since[need + j], left[j:])
            keys.append(key)
            mine = (doc, at + j)
            if earliest.setdefault(key, mine) > mine:
                earliest[key] = mine
        listed.append(keys)
    for (doc, at, members, *_), keys in zip(entries, listed):
        gone = [j for j, key in enumerate(keys) if earliest[key] < (doc, at + j)]
        for first, n in _spans(gone):
            for d, a, block, row in members:
                if (d, a) == (doc, at):
                    yield block, row, at + first, n


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
            names=["block", "row", "at", "n"],
        )

    def passed(batches: Iterator[pa.RecordBatch], known: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the rows with runs; the others are collected in ``known``."""
        for batch in batches:
            has = batch.column("run").is_valid()
            plain = batch.filter(pa.compute.invert(has))
            if plain.num_rows:
                known.append(plain.select(["block", "row", "at", "n"]))
            yield batch.filter(has).select(["part", "run"])

    known: list[pa.RecordBatch] = []
    for _, rows in _by_key(passed(batches, known)):
        runs = [_Run(r[1]) for r in rows]
        found: list[tuple] = []
        group: list[tuple] = []
        for r, i, shared in lcp_merge.merge([x.right for x in runs], [x.shared for x in runs]):
            run = runs[r]
            if shared < SEED_BYTES:
                if len(group) > 1:
                    found.extend(resolve(group))
                group = []
            group.append((run.right[i], run.left[i], run.id[i], run.at[i], run.block[i], run.row[i], shared))
            if len(found) > 20_000:
                yield flush(found)
                found = []
        if len(group) > 1:
            found.extend(resolve(group))
        if found:
            yield flush(found)
        while known:
            yield known.pop()
    yield from known
    release_memory()


def _cut(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut_blocks(batch, as_text)
        release_memory()

    return run


def _cut_blocks(batch: pa.RecordBatch, as_text: bool) -> Iterator[pa.RecordBatch]:
    for packed, spans in zip(batch.column("packed"), batch.column("spans")):
        block = Block(packed.as_buffer(), find=False)
        change = np.zeros(len(block.data) + 1, np.int64)
        if spans.is_valid:
            flat = spans.values
            row, at, n = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            first = block.starts[row] + at
            change += np.bincount(first, minlength=len(change))
            change -= np.bincount(first + n - 1 + WINDOW, minlength=len(change))
        gone = np.cumsum(change[:-1]) > 0
        kept, removed, pieces = [], [], []
        for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist()):
            g = gone[a:b]
            removed.append(int(g.sum()))
            pieces.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            kept.append(block.data[a:b][~g].tobytes() if removed[-1] else block.data[a:b].tobytes())
        rest = [block.batch.column(c) for c in block.batch.schema.names if c != "text"]
        names = [c for c in block.batch.schema.names if c != "text"]
        yield pa.record_batch(
            [
                *rest, pa.array(np.diff(block.starts), pa.int64()), pa.array(removed, pa.int64()),
                pa.array(pieces, pa.int64()),
                pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
            ],
            names=[*names, "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _splitters(blocks: DataFrame, ranges: int) -> np.ndarray:
    """Bounds of about equal ranges of the first eight bytes at anchors, from one anchor in 64."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("packed"):
                block = Block(packed.as_buffer())
                place = block.place[(block.hash & np.uint64(63)) == 0]
                right = block.data[place[:, None] + np.arange(8)[None, :]]
                yield pa.record_batch([pa.array((_prefix(right) ^ np.uint64(1 << 63)).view(np.int64))], names=["prefix"])

    if ranges < 2:
        return np.zeros(0, np.uint64)
    shares = [i / ranges for i in range(1, ranges)]
    found = (
        blocks.mapInArrow(prefixes, "prefix bigint")
        .agg(F.percentile_approx("prefix", F.array(*map(F.lit, shares)), F.lit(20 * ranges))).head()[0]
    )
    return np.unique(np.array(found or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63))


def dedup_suffixes(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, the columns named in ``carry``, n_bytes, n_removed, n_spans and kept (bytes) for every row.

    A byte goes if a string of 100 bytes covers it that also starts earlier: in a row with a
    smaller doc_id, or with the same doc_id at a smaller offset. Texts are UTF-8 bytes, null
    counts as empty; matches stay inside a row. Rows with a null doc_id stay whole and remove
    nothing. Repeated rows (same doc_id) don't remove each other at equal offsets and come back
    as often as they occur. Columns not named are ignored, those named must not clash with the
    result's; an empty table gives an empty result.
    A text may hold 256 MB. With ``as_text`` what is kept is text; a character of which a part
    was cut goes whole.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, *carry)
    blocks = materialise(spark, rows.mapInArrow(_pack, "block bigint, packed binary"), "blocks")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * ranges
    answers = (
        blocks.mapInArrow(_ask(buckets), "bucket bigint, block bigint, hashes binary")
        .repartition("bucket").sortWithinPartitions("bucket")
        .mapInArrow(_answer, "block bigint, bucket bigint, bits binary")
        .groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    )
    splitters = spark.sparkContext.broadcast(_splitters(blocks, ranges))
    found = (
        blocks.join(answers, "block").mapInArrow(_send(buckets, splitters), ROUTED)
        .repartition("part").sortWithinPartitions("part")
        .mapInArrow(_merge, "block bigint, row int, at int, n int")
        .groupBy("block").agg(F.collect_list(F.struct("row", "at", "n")).alias("spans"))
    )
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return blocks.join(found, "block", "left").select("packed", "spans").mapInArrow(
        _cut(as_text), kinds + f"n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if as_text else 'binary'}"
    )


def with_cut_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, n_chars, others) with what ``dedup_suffixes`` leaves of each text.

    A character of which a part was cut goes whole; n_chars is counted anew; no row goes. A null
    text becomes an empty one.
    """
    others = {c: f"_column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    carried = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(name) for c, name in others.items()])
    cut = dedup_suffixes(carried, tuple(others.values()), as_text=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return cut.select(*[(made[c] if c in made else F.col(others[c])).alias(c) for c in docs.columns])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


# Every string of 100 bytes, as hexadecimal digits, by its digest; texts are cut into overlapping pieces first.
OP10_SQL = """
WITH held AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), pieces AS (
    SELECT doc_id, n, piece, substr(h, 1000 * piece + 1, 1198) AS p
    FROM (SELECT doc_id, h, n, CAST(unnest(range(0, (n + 499) // 500)) AS BIGINT) AS piece FROM held)
), places AS (
    SELECT doc_id, n, piece, p, CAST(unnest(range(1, least(500, n - 500 * piece) + 1)) AS BIGINT) AS k FROM pieces
), strings AS (
    SELECT doc_id, 500 * piece + k AS pos, substr(p, 2 * k - 1, 2) AS code,
        CASE WHEN 500 * piece + k <= n - 99 THEN md5(substr(p, 2 * k - 1, 200)) END AS s FROM places
), firsts AS (
    SELECT doc_id, pos, code, CAST(s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1 AS INT) AS again FROM strings
), covered AS (
    SELECT doc_id, pos, code, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM firsts
), runs AS (
    SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM covered
), per AS (
    SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans,
        string_agg(code, '' ORDER BY pos) FILTER (WHERE gone = 0) AS kept
    FROM runs GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM held LEFT JOIN per USING (doc_id)
"""
