"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the whole corpus are counted; the most frequent ones (LEXICON_WORDS at most, each
of LONGEST characters at most) are compiled with their token ids into a shared-suffix
transducer of a few megabytes. Every Python process maps it into memory and walks all words of
a slice at once; words it doesn't hold are merged exactly, pair by pair. The text itself is
never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordbpe
from tidemark.llm.common import heaviest, materialise, read, slices, texts_of
from tidemark.llm.lexicon import LONGEST, Lexicon, compile_lexicon

LEXICON_WORDS = 1 << 17
HELD_WORDS = 100_000  # distinct words that one task counts before it passes them on
MEMO_WORDS = 100_000  # merged words that one process remembers at a time


def _count_words(tokenizer_path: str):
    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(tokenizer_path)
        counts: Counter = Counter()
        for batch in slices(batches, "text"):
            for text in texts_of(batch):
                counts.update(bpe.words(text) or ())
            if len(counts) >= HELD_WORDS:
                yield flush(counts)
                counts.clear()
        yield flush(counts)

    return run


def frequent_words(docs: DataFrame, tokenizer_path: str, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, ``limit`` at most; words that occur once are never among them."""
    counted = materialise(
        docs.sparkSession,
        docs.select("text").mapInArrow(_count_words(tokenizer_path), "word string, n bigint")
        .where(F.length("word") <= LONGEST)
        .groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"),
        "word-counts",
    )
    return [r.word for r in heaviest(counted, "n", limit).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer_path: str, limit: int = LEXICON_WORDS) -> bytes:
    bpe = wordbpe.load(tokenizer_path)
    return compile_lexicon({w: bpe.merge(w) for w in frequent_words(docs, tokenizer_path, limit)})


class Encoder:
    """Encodes slices of texts with a mapped lexicon."""

    def __init__(self, packed: bytes, bpe: wordbpe.WordBpe):
        self.lexicon, self.bpe, self.merged = Lexicon(packed), bpe, {}
        self.words = len(self.lexicon.first) - 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.bpe.words(t) for t in texts]
        words = [w for piece in cut if piece for w in piece]
        rank = self.lexicon.ranks(words)
        unseen = np.flatnonzero(rank < 0)
        extra: dict[str, int] = {}
        extra_ids: list[list[int]] = []
        places = np.empty(len(unseen), np.int64)
        for k, i in enumerate(unseen.tolist()):
            place = extra.get(words[i])
            if place is None:
                place = extra[words[i]] = len(extra_ids)
                extra_ids.append(self._merge(words[i]))
            places[k] = place
        rank[unseen] = self.words + places
        sizes = np.concatenate([np.diff(self.lexicon.first), np.fromiter(map(len, extra_ids), np.int64, len(extra_ids))])
        pool = np.concatenate([self.lexicon.ids, np.array([i for ids in extra_ids for i in ids], np.int32)])
        first = np.cumsum(sizes) - sizes
        n = sizes[rank]
        ends = np.cumsum(n)
        ids = pool[np.repeat(first[rank] - (ends - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], ends])
        out, at = [], 0
        for text, piece in zip(texts, cut):
            if piece is None:
                out.append(np.array(self.bpe.encode(text), np.int32))
            else:
                out.append(ids[ends[at] : ends[at + len(piece)]])
                at += len(piece)
        return out

    def _merge(self, word: str) -> list[int]:
        ids = self.merged.get(word)
        if ids is None:
            if len(self.merged) >= MEMO_WORDS:
                self.merged.clear()
            ids = self.merged[word] = self.bpe.merge(word)
        return ids


ENCODED = "doc_id bigint, n_tokens bigint, ids binary, decoded string"


def _encode(packed, tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(tokenizer_path)
        encoder = Encoder(packed.value, bpe)
        tokens = bpe.tokens
        for batch in slices(batches, "text"):
            ids = encoder.encode(texts_of(batch))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                    pa.array([" ".join([tokens[k] for k in i.tolist()]) for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded text for every row of ``docs``.

    Ids are those of the tokenizer library without added special tokens; the tokenizer file has
    no decoder, so decoding joins the token strings with one space. Null text counts as empty
    (no ids, empty text); a null doc_id is kept. Repeated rows come back as often as they occur,
    other columns are ignored, an empty table gives an empty result. The lexicon only decides
    what is looked up and what is merged, never the ids.
    """
    path = tokenizer_path or wordbpe.default_path()
    packed = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, lexicon_words))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_encode(packed, path), ENCODED)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(read(spark, sf_dir, "documents")))
