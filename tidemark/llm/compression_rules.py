"""Quality rules by compression bands.

Besides the plain counts, every text is compressed with zstandard as a whole and in fixed
chunks. Ratios (raw bytes / compressed bytes) outside limits that depend on the length reject
the text: too high means repetitive, too low means incompressible (random or encoded) content.
Short texts compress less and scripts differ, so the lower limits rise with the length and are
set by script, a few percent under the lowest ratios measured on prose (sf0.1, manuals, and
translated program texts of about 50 languages). Random printable characters, letters with digits,
base64 and random Han or Hangul characters lie under them from about 300 to 1,500 bytes on,
hexadecimal digits, which compress like short prose, from 4 KB on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, slices, texts_of

LEVEL = 3
CHUNK_BYTES = 4096
# (length in bytes below which it holds, highest ratio)
HIGHEST = [(256, 2.5), (1024, 3.0), (4096, 3.6), (16384, 4.5), (None, 6.0)]
# Lowest ratios at these lengths in bytes; in between they grow with the logarithm of the length.
LENGTHS = [96, 128, 200, 300, 512, 800, 1024, 1500, 2048, 3000, 4096, 8192, 16384]
LOWEST = {
    "latin": [0.8, 0.92, 1.08, 1.16, 1.29, 1.43, 1.51, 1.63, 1.71, 1.81, 1.94, 2.13, 2.2],
    "accented": [0.75, 0.86, 1.0, 1.08, 1.2, 1.31, 1.38, 1.48, 1.55, 1.65, 1.77, 1.95, 2.05],
    "other": [0.8, 0.92, 1.1, 1.2, 1.27, 1.45, 1.56, 1.75, 1.86, 2.0, 2.1, 2.35, 2.6],
    "hangul": [0.7, 0.77, 0.94, 1.03, 1.2, 1.33, 1.4, 1.55, 1.65, 1.78, 1.88, 2.1, 2.3],
    "han": [0.6, 0.68, 0.86, 0.93, 1.05, 1.15, 1.2, 1.27, 1.33, 1.4, 1.43, 1.5, 1.55],
}
# First bytes of UTF-8 characters: Han and kana; Hangul; Greek, Cyrillic, Hebrew, Arabic, Indic, Thai and so on; Latin beyond ASCII.
LEADS = {
    "han": bytes([*range(0xE3, 0xEA), 0xF0]), "hangul": bytes(range(0xEA, 0xEE)), "other": bytes([*range(0xCD, 0xE0), 0xE0, 0xE1]),
    "accented": bytes([*range(0xC3, 0xCD), 0xE1]),
}
SHARES = {"han": 20, "hangul": 20, "other": 50, "accented": 1}  # percent of characters from which a text is of that script
FOLLOWING = bytes(range(0x80, 0xC0))
HIGHEST_CHUNK = 5.0
BAD_CHUNK_PERCENT = 30  # share of bytes in chunks outside their limits from which a text is rejected
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACES = (" ", "\t", "\n", "\r", "\x0b", "\x0c")


def plain_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = text.encode("utf-8")
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a three-word window that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def script(raw: bytes) -> str:
    """The first of LEADS that has its share of the characters, or else latin."""
    if not raw.isascii():
        chars = len(raw.translate(None, FOLLOWING))
        for name, leads in LEADS.items():
            if 100 * (len(raw) - len(raw.translate(None, leads))) >= SHARES[name] * chars:
                return name
    return "latin"


def lowest(n_bytes: int, of: str) -> float:
    return float(np.interp(np.log2(max(n_bytes, 1)), np.log2(LENGTHS), LOWEST[of]))


def band(n_bytes: int, of: str = "latin") -> tuple[float, float]:
    return lowest(n_bytes, of), next(high for below, high in HIGHEST if below is None or n_bytes < below)


def compression(raw: bytes, compress) -> tuple[float, int]:
    """Whole-text ratio (0 for an empty text) and percent of bytes in chunks outside their limits."""
    if not raw:
        return 0.0, 0
    whole = len(raw) / len(compress(raw))
    if len(raw) < CHUNK_BYTES:
        return whole, 0
    bad = 0
    cuts = [*range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES), len(raw)]  # the last chunk takes the rest
    for a, b in zip(cuts, cuts[1:]):
        chunk = raw[a:b]
        if not lowest(b - a, script(chunk)) <= (b - a) / len(compress(chunk)) <= HIGHEST_CHUNK:
            bad += b - a
    return whole, 100 * bad // len(raw)


RESULT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, bad_chunk_percent bigint"
)
KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.int64()]
NAMES = ["doc_id", *(c.split()[0] for c in RESULT.split(", ")[1:])]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in slices(batches, "text"):
        rows = []
        for text in texts_of(batch):
            counts = plain_counts(text)
            raw = text.encode("utf-8")
            ratio, bad = compression(raw, compress)
            n, repeated = counts[0], counts[4]
            failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
            low, high = band(len(raw), script(raw))
            rows.append((*counts, failed, not failed and low <= ratio <= high and bad < BAD_CHUNK_PERCENT, ratio, bad))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), KINDS)]
        yield pa.record_batch([batch.column("doc_id"), *columns], names=NAMES)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row of counts, ratio and verdict per row of ``docs``; nothing is shuffled.

    Null text counts as empty: no words, ratio 0, base_failed. A null doc_id is kept. Repeated
    rows come back as often as they occur; other columns are ignored; an empty table gives an
    empty result. Words are runs of characters other than space and \\x09-\\x0D.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_judge, RESULT)


def op4_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))
