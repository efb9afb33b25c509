import random

import numpy as np
import pytest
from llm_cases import docs, empty_docs, rows, same_rows, sha

from tidemark.llm import lexicon, lexicon_bpe, token_counts, wordbpe


@pytest.fixture(scope="module")
def bpe():
    return wordbpe.load(wordbpe.default_path())


def library_ids(bpe, text):
    return bpe.library.encode(text or "", add_special_tokens=False).ids


def test_pieces_and_merges_match_the_library(bpe):
    rnd = random.Random(1)
    pool = [chr(c) for c in range(0x20, 0x180)] + list("''''  sstdmrevl\n\t") * 8
    for _ in range(1500):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60)))
        pieces = bpe.words(text)
        if pieces is not None:
            assert [i for p in pieces for i in bpe.merge(p)] == library_ids(bpe, text)
    for word in ("a" * 500, "abc" * 90, "ß" * 60):
        assert bpe.merge(word) == library_ids(bpe, word)


def test_lexicon_ranks_and_sharing():
    rnd = random.Random(2)
    entries = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 9))): [rnd.randint(0, 99)] * rnd.randint(1, 3) for _ in range(3000)}
    lex = lexicon.Lexicon(lexicon.compile_lexicon(entries))
    known = sorted(entries)
    asked = known + ["", "zz", "a" * 100, "abcx", known[0] + "!"]
    ranks = lex.ranks(asked)
    assert ranks[: len(known)].tolist() == list(range(len(known)))
    assert all((r == -1) == (w not in entries) for w, r in zip(asked, ranks.tolist()))
    assert all(lex.ids[lex.first[i] : lex.first[i + 1]].tolist() == entries[w] for i, w in enumerate(known))
    states = len(lexicon._minimal(["cars", "cats", "mars", "mats"])[1])
    assert states == 5  # start, after c/m, after a, after r/t, end
    assert lexicon.Lexicon(lexicon.compile_lexicon({})).ranks(["a", ""]).tolist() == [-1, -1]


@pytest.mark.parametrize("size", [0, 20, 1 << 17])
def test_encode_decode_matches_the_library(spark, bpe, size):
    expected = []
    for doc_id, text, _ in rows():
        ids = library_ids(bpe, text)
        decoded = bpe.library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())))
    same_rows(lexicon_bpe.digests(lexicon_bpe.encode_decode(docs(spark), lexicon_words=size)), expected)
    assert lexicon_bpe.encode_decode(empty_docs(spark)).count() == 0


def test_token_counts_and_cache(spark, bpe, tmp_path):
    cache = str(tmp_path / "cache")
    expected = []
    for doc_id, text, _ in rows():
        n = len(library_ids(bpe, text))
        expected.append((doc_id, len((text or "").encode()), n, n > 2048))
    first = docs(spark, rows()[:9])
    assert token_counts.count_tokens(empty_docs(spark), cache).count() == 0
    same_rows(token_counts.count_tokens(first, cache), expected[:9])
    stored = spark.read.parquet(cache).count()
    assert stored == len({" ".join((t or "").split()) for _, t, _ in rows()[:9]})
    same_rows(token_counts.count_tokens(first, cache), expected[:9])
    assert spark.read.parquet(cache).count() == stored  # all hits: nothing was encoded
    same_rows(token_counts.count_tokens(docs(spark), cache), expected)


def test_cache_is_used_and_tied_to_the_tokenizer(spark, tmp_path):
    cache = str(tmp_path / "cache")
    frame = docs(spark, [(1, "some  words", "a"), (2, "some words", "a")])
    token_counts.count_tokens(frame, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 1
    altered = spark.createDataFrame([(stored.first().content, stored.first().tokenizer, 77)], token_counts.CACHE_SCHEMA)
    altered.write.parquet(str(tmp_path / "other"))
    assert [r.n_tokens for r in token_counts.count_tokens(frame, str(tmp_path / "other")).collect()] == [77, 77]
    stale = spark.createDataFrame([(stored.first().content, "older", 77)], token_counts.CACHE_SCHEMA)
    stale.write.parquet(str(tmp_path / "stale"))
    assert [r.n_tokens for r in token_counts.count_tokens(frame, str(tmp_path / "stale")).collect()] == [2, 2]
