"""Benchmark decontamination: BM25 over test items with block-max pruning, then shingle overlap.

The test items are indexed (an inverted index of their words with BM25 weights), and every
passage of every document is a query. Weights are divided by the item's own score, so that a
passage holding all of an item's words scores 1 whatever the item. As in WAND, the words that
most items hold are non-essential: together they can't add more than SLACK to any item, and are
looked up only for items that come near the threshold without them. Items are kept in blocks,
and each word has its largest weight in each block. Instead of moving one passage's cursors from
pivot to pivot, the passages of a run are bounded block by block at once, in arrays; postings are
scored only for passages and blocks whose bound reaches the threshold. Both skip the same blocks, and
both are exact. All items above the threshold are then verified by the five-word shingles that the
passage holds: of the whole item, or of its question and its answer each, so that text between the
two doesn't hide an item.

Indexes hold INDEX_ITEMS items and about INDEX_WORDS words at most. They are built in tasks, written
to the shared folder, and reach the searching tasks one by one, as many as HELD_BYTES allow for one
pass over the documents. Passages are searched in runs of bounded size, however long a text is.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import winnow
from tidemark.llm.common import materialise, read, slices, texts_of, whole_row
from tidemark.operators.keyed import numbered

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # share of an item's own score
SLACK = 0.2  # what non-essential words may add to an item
MARGIN = 1e-6  # for sums in floating point
SHINGLE = 5
SLICE_BYTES = 1_000_000  # short texts searched together
HASHED_BYTES = 1 << 20  # of a text, split into words at a time
RUN_WORDS = 1 << 18  # of a text, searched at a time
RUN_SUMS = 1 << 22  # sums and postings of the passages searched at a time
OVERLAP = 0.8
INDEX_ITEMS = 2048
INDEX_WORDS = 1 << 20  # of the items in one index (a longer item has an index of its own)
HELD_BYTES = 1 << 28  # of the indexes searched in one pass over the documents
BLOCK_ITEMS = 8
SENTENCE_END = re.compile(r"[.!?:]\s+|\n+")

# Words are runs of ASCII letters and digits, lower-cased, and of all other characters beyond ASCII.
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """Hashes of the words of some texts, in order, with the first word of each text."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8") for t in texts]
        data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        hashes, begins, at = [], [], 0
        while at < len(data):
            to = at + HASHED_BYTES
            while to < len(data):  # up to the next gap between words
                gaps = np.flatnonzero(~IN_WORD[data[to : to + HASHED_BYTES]])
                if len(gaps):
                    to += int(gaps[0]) + 1
                    break
                to += HASHED_BYTES
            part = data[at:to]
            inside = np.concatenate([[False], IN_WORD[part], [False]])
            starts = np.flatnonzero(~inside[:-1] & inside[1:])
            ends = np.flatnonzero(inside[:-1] & ~inside[1:])
            hashes.append(winnow.word_hashes(LOWER[part] + np.uint64(1), starts, ends))
            begins.append(starts + at)
            at = to
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
        self.first = np.searchsorted(starts, np.cumsum([1, *(len(r) + 1 for r in raw)]))


def question_and_answer(text: str) -> tuple[str, str]:
    """Everything but the last sentence or line, and the last one; one sentence is both."""
    body = text.strip()
    ends = [m.end() for m in SENTENCE_END.finditer(body) if m.end() < len(body)]
    return (body[: ends[-1]], body[ends[-1] :]) if ends else (body, body)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(winnow.Spans(words).grams(size)) if size else np.zeros(0, np.uint64)


class Index:
    """Some items, ready to be searched. Plain arrays, a few bytes for each word of an item."""

    def __init__(self, items: list[dict], n_items: int, mean_length: float, longest: int):
        """``items``: item_id, words (hashes), n_question, dfs (hash -> number of items that hold it)."""
        self.ids = [i["item_id"] for i in items]
        self.passage = 2 * max(longest, SHINGLE)
        self.parts = []
        vocabulary = sorted({w for i in items for w in i["dfs"]})
        place = {w: k for k, w in enumerate(vocabulary)}
        self.vocabulary = np.array(vocabulary, np.uint64)
        rows, columns, weights = [], [], []
        for k, item in enumerate(items):
            words = np.array(item["words"], np.uint64)
            q = item["n_question"]
            parts = (words, words[:q], words[item["answer_from"] :])
            parts = parts if all(map(len, parts)) else (words, words, words)
            self.parts.append([(min(SHINGLE, len(p)), shingles(p, min(SHINGLE, len(p)))) for p in parts])
            unique, counts = np.unique(words, return_counts=True)
            df = np.array([item["dfs"][w] for w in unique.tolist()], float)
            idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
            norm = K1 * (1 - B + B * len(words) / mean_length)
            weight = idf * counts * (K1 + 1) / (counts + norm)
            rows += [place[w] for w in unique.tolist()]
            columns += [k] * len(unique)
            weights += (weight / weight.sum()).tolist()
        order = np.argsort(rows, kind="stable")
        self.item = np.array(columns, np.int64)[order]
        self.weight = np.array(weights)[order]
        row = np.array(rows, np.int64)[order]
        self.start = np.searchsorted(row, np.arange(len(vocabulary) + 1))
        self._bounds(row)

    def _bounds(self, row: np.ndarray) -> None:
        """Essential words, what the others add to each item, and the largest weights by word and block."""
        spread = np.diff(self.start)
        self.essential = np.ones(len(spread), bool)
        self.rest = np.zeros(len(self.ids))
        for least in sorted(set(spread.tolist()), reverse=True):
            common = spread >= least
            rest = np.bincount(self.item, self.weight * common[row], len(self.ids))
            if len(rest) and rest.max() > SLACK:
                break
            self.essential, self.rest = ~common, rest
        self.blocks = -(-len(self.ids) // BLOCK_ITEMS)
        use = self.essential[row]
        pair, where = np.unique(row[use] * self.blocks + self.item[use] // BLOCK_ITEMS, return_inverse=True)
        self.largest = np.zeros(len(pair))
        np.maximum.at(self.largest, where, self.weight[use])
        self.block = pair % self.blocks
        self.block_start = np.searchsorted(pair // self.blocks, np.arange(len(spread) + 1))
        self.block_rest = np.zeros(self.blocks)
        np.maximum.at(self.block_rest, np.arange(len(self.ids)) // BLOCK_ITEMS, self.rest)

    def search(self, words: Words) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item, score, overlap, question overlap, answer overlap) of verified hits, the best passage of each."""
        hits: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        # Passages: windows with half a window between their starts, in each text.
        sizes, step = np.diff(words.first), self.passage // 2
        counts = np.maximum(-(-(sizes - step) // step), (sizes > 0).astype(np.int64))
        base = np.cumsum(counts) - counts
        text = np.repeat(np.arange(len(sizes)), counts)
        begin = words.first[text] + (np.arange(int(counts.sum())) - base[text]) * step
        end = np.minimum(begin + self.passage, words.first[text + 1])
        at = 0
        while at < len(begin):
            to = int(np.searchsorted(begin, begin[at] + max(RUN_WORDS, 1)))
            self._search_run(words, text[at:to], begin[at:to], end[at:to], hits)
            at = to
        return [(t, i, score, whole, q, a) for (t, i), (whole, score, q, a) in sorted(hits.items())]

    def _search_run(self, words: Words, text: np.ndarray, begin: np.ndarray, end: np.ndarray, hits: dict) -> None:
        """Add the hits of some passages, given by text, first word and end."""
        low, step = int(begin[0]), self.passage // 2
        hashes = words.hashes[low : int(end[-1])]
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        place = np.flatnonzero(self.vocabulary[at] == hashes)
        term = at[place]
        place += low
        # Each place lies in two passages at most; a word counts once, at its first place in the passage.
        order = np.argsort(term, kind="stable")
        before = np.full(len(term), -1)
        same = term[order][1:] == term[order][:-1]
        before[order[1:][same]] = place[order[:-1][same]]
        last = np.searchsorted(begin, place, "right") - 1
        passages, terms = [], []
        for p in (last, last - 1):
            held = np.maximum(p, 0)
            valid = np.flatnonzero((p >= 0) & (place < end[held]) & (before < begin[held]))
            passages.append(p[valid])
            terms.append(term[valid])
        passage, term = np.concatenate(passages), np.concatenate(terms)
        order = np.argsort(passage, kind="stable")
        passage, term = passage[order], term[order]
        # Passages are scored together as far as their sums and postings go into RUN_SUMS.
        postings = np.bincount(passage, np.diff(self.start)[term], len(begin)).astype(np.int64)
        cost = np.cumsum(postings + len(self.ids))
        spans, left = None, max(low - step, 0)
        at = 0
        while at < len(begin):
            held = int(cost[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(cost, held + RUN_SUMS, "right")))
            mine = slice(*np.searchsorted(passage, [at, to]))
            for p, item, value in self._candidates(passage[mine] - at, term[mine], to - at):
                p += at
                if spans is None:
                    spans = winnow.Spans(words.hashes[left : int(end[-1]) + step])
                own = (int(begin[p]), int(end[p]))
                near_by = (max(own[0] - step, int(words.first[text[p]])), min(own[1] + step, int(words.first[text[p] + 1])))
                ranges = [(a - left, b - left) for a, b in (own, near_by, near_by)]
                whole, q, a = self._verify(spans, ranges, item)
                key = (int(text[p]), item)
                if (whole >= OVERLAP or min(q, a) >= OVERLAP) and (whole, value) > hits.get(key, (-1.0, 0.0))[:2]:
                    hits[key] = (whole, value, q, a)
            at = to

    def _candidates(self, passage: np.ndarray, term: np.ndarray, passages: int) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) at or above the threshold, by block bounds first."""
        use = self.essential[term]
        bound = self._sums(passage[use], term[use], self.block_start, self.block, self.largest, passages, self.blocks)
        alive = bound + self.block_rest >= THRESHOLD - MARGIN
        use &= alive.any(axis=1)[passage]
        score = self._sums(passage[use], term[use], self.start, self.item, self.weight, passages, len(self.ids), alive)
        near = score + self.rest >= THRESHOLD - MARGIN
        use = ~self.essential[term] & near.any(axis=1)[passage]
        score += self._sums(passage[use], term[use], self.start, self.item, self.weight, passages, len(self.ids))
        for p, item in np.argwhere(near & (score >= THRESHOLD - MARGIN)).tolist():
            yield p, item, float(score[p, item])

    @staticmethod
    def _sums(passage, term, start, column, weight, rows: int, columns: int, alive=None) -> np.ndarray:
        """Sums of the terms' weights by passage and column; ``alive`` names the passages and blocks to look at."""
        sizes = start[term + 1] - start[term]
        posting = np.repeat(start[term] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        row = np.repeat(passage, sizes)
        column = column[posting]
        if alive is not None:
            keep = alive[row, column // BLOCK_ITEMS]
            posting, row, column = posting[keep], row[keep], column[keep]
        return np.bincount(row * columns + column, weight[posting], rows * columns).reshape(rows, columns)

    def _verify(self, spans: winnow.Spans, ranges: list[tuple[int, int]], item: int) -> tuple[float, float, float]:
        """Shares of the shingles of item, question and answer that these ranges of words hold."""
        out = []
        for (begin, end), (size, wanted) in zip(ranges, self.parts[item]):
            starts = np.arange(begin, end - size + 1)
            held = np.unique(spans.hash(starts, starts + size)) if len(starts) else np.zeros(0, np.uint64)
            out.append(len(np.intersect1d(held, wanted, assume_unique=True)) / len(wanted))
        return out[0], out[1], out[2]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item_id, text in zip(batch.column("item_id").to_pylist(), texts_of(batch)):
            question, answer = question_and_answer(text)
            w = Words([text, question, answer])
            n, q, a = np.diff(w.first).tolist()
            rows.append((item_id, w.hashes[:n].view(np.int64).tolist(), q, n - a))
        columns = zip(*rows) if rows else ([], [], [], [])
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "words", "n_question", "answer_from"])


def _packed(n_items: int, mean_length: float, longest: int):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = [
            {
                "item_id": None if pd.isna(r.item_id) else int(r.item_id), "words": np.asarray(r.words, np.int64).view(np.uint64),
                "n_question": r.n_question, "answer_from": r.answer_from, "dfs": {d["word"] % (1 << 64): d["df"] for d in r.dfs},
            }
            for r in rows.sort_values("row").itertuples()
        ]
        return pd.DataFrame({"packed": [pickle.dumps(Index(items, n_items, mean_length, longest))]})

    return build


def build_indexes(items: DataFrame, index_items: int = INDEX_ITEMS) -> DataFrame:
    """packed (binary): indexes of all ``items`` (item_id, text) that have a word, built in tasks and written.

    Items of up to INDEX_WORDS / ``index_items`` words come ``index_items`` to an index; of items up to
    twice as long half as many, and so on. Document frequencies are those of all items.
    """
    spark = items.sparkSession
    rows = materialise(
        spark,
        items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
        .mapInArrow(_item_words, "item_id bigint, words array<bigint>, n_question int, answer_from int")
        .where(F.size("words") > 0).withColumn("row", F.monotonically_increasing_id()),
        "test-items",
    )
    n, mean, longest = rows.agg(F.count("*"), F.avg(F.size("words")), F.max(F.size("words"))).head()
    share = F.size("words") / F.lit(max(INDEX_WORDS // index_items, 1))
    grade = F.greatest(F.lit(0), F.ceil(F.log2(share))).cast("int").alias("grade")
    places = materialise(spark, numbered(rows.select("row", grade), [F.col("grade"), F.col("row")], "place"), "item-places")
    starts = places.groupBy(F.col("grade").alias("of")).agg(F.min("place").alias("start"))  # 32 rows at most
    many = F.greatest(F.lit(1), F.floor(F.lit(index_items) / F.pow(F.lit(2.0), "grade")))
    numbers = places.join(F.broadcast(starts), F.col("grade") == F.col("of")).select(
        F.col("row").alias("item_row"), "grade", F.floor((F.col("place") - F.col("start")) / many).alias("number")
    )
    words = rows.select("row", F.explode(F.array_distinct("words")).alias("word"))
    counted = words.join(words.groupBy("word").agg(F.count("*").alias("df")), "word")
    with_df = rows.join(counted.groupBy("row").agg(F.collect_list(F.struct("word", "df")).alias("dfs")), "row")
    built = (
        with_df.join(numbers, F.col("row") == F.col("item_row"))
        .groupBy("grade", "number").applyInPandas(_packed(n, mean, longest), "packed binary")
    )
    return materialise(spark, built, "test-indexes")


def index_groups(items: DataFrame, index_items: int) -> Iterator[list]:
    """Indexes as broadcast variables, in groups of HELD_BYTES at most (one index at least).

    One index at a time passes through the driver.
    """
    context, group, held = items.sparkSession.sparkContext, [], 0
    for r in build_indexes(items, index_items).toLocalIterator():
        if group and held + len(r.packed) > HELD_BYTES:
            yield group
            group, held = [], 0
        group.append(context.broadcast(pickle.loads(r.packed)))
        held += len(r.packed)
    if group:
        yield group


FOUND = "doc_id bigint, item_id bigint, score double, overlap double, question_overlap double, answer_overlap double"


def _search(indexes: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            words = Words(texts_of(batch))
            for index in indexes:
                hits = index.value.search(words)
                if hits:
                    text, item, score, whole, q, a = zip(*hits)
                    yield pa.record_batch(
                        [
                            batch.column("doc_id").take(pa.array(text)), pa.array([index.value.ids[i] for i in item], pa.int64()),
                            *(pa.array(c, pa.float64()) for c in (score, whole, q, a)),
                        ],
                        names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"],
                    )

    return run


def contaminated(docs: DataFrame, items: DataFrame, index_items: int = INDEX_ITEMS) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap: items found in rows of ``docs``.

    An item is found where one passage (twice as many words as the longest item has, starting
    every half passage) scores at least THRESHOLD of the item's own BM25 score and holds at least
    OVERLAP of its distinct five-word shingles, or OVERLAP of those of its question and of its
    answer alike in the passage and half a passage on either side (see ``question_and_answer``; an item
    without a split is both). Parts of fewer words count as one shingle. Per row and item the passage with the largest overlap is reported. Null texts and items without
    words match nothing; null ids are kept; repeated rows are reported as often as they occur and
    repeated items each on their own. Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = spark.createDataFrame([], FOUND)
    for group in index_groups(items, index_items):
        out = out.unionByName(docs.mapInArrow(_search(group), FOUND))
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, index_items: int = INDEX_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found (see ``contaminated``)."""

    def clean(indexes: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", SLICE_BYTES):
                words, keep = Words(texts_of(batch)), np.ones(batch.num_rows, bool)
                for index in indexes:
                    keep[[h[0] for h in index.value.search(words)]] = False
                yield batch.filter(pa.array(keep))

        return run

    rows, passes = docs.select(whole_row(docs.columns).alias("row"), "text"), 0
    for group in index_groups(items, index_items):
        rows = materialise(docs.sparkSession, rows, "clean-so-far") if passes else rows
        rows, passes = rows.mapInArrow(clean(group), rows.schema), passes + 1
    return rows.select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
