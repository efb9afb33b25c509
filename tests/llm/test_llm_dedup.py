import random

import numpy as np
import pytest
import xxhash
from llm_cases import docs, empty_docs, prose, rows, same_rows, sha, words

from tidemark.llm import components, lcp_merge, simhash_ball, span_dedup, suffix_dedup, winnow


def random_rows(seed: int) -> list[tuple]:
    """Documents glued from few sentences, so that many windows repeat."""
    rnd = random.Random(seed)
    pool = [prose(100 + i, rnd.randint(5, 70)) for i in range(12)]
    return [(rnd.randint(0, 40), " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 6))), "s") for _ in range(60)]


def plain_spans(data):
    windows = [[tuple(w[p : p + 50]) for p in range(len(w) - 49)] for w in (words(t) for _, t, _ in data)]
    lowest = {}
    for (doc, *_), found in zip(data, windows):
        for w in found if doc is not None else ():
            lowest[w] = min(lowest.get(w, doc), doc)
    out = []
    for (doc, text, _), found in zip(data, windows):
        w = words(text)
        gone = [False] * len(w)
        for p, x in enumerate(found if doc is not None else ()):
            if lowest[x] < doc:
                gone[p : p + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), len(w) - len(kept), sha(" ".join(kept).encode())))
    return out


def plain_bytes(data):
    size = suffix_dedup.WINDOW
    first = {}
    for doc, text, _ in data:
        raw = (text or "").encode()
        for p in range(len(raw) - size + 1) if doc is not None else ():
            key = raw[p : p + size]
            first[key] = min(first.get(key, (doc, p)), (doc, p))
    out = []
    for doc, text, _ in data:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - size + 1) if doc is not None else ():
            if first[raw[p : p + size]] < (doc, p):
                gone[p : p + size] = b"\1" * size
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(raw), len(raw) - len(kept), spans, sha(kept)))
    return out


@pytest.mark.parametrize("data", [rows(), random_rows(1), random_rows(2), []])
def test_span_dedup(spark, data):
    from pyspark.sql import functions as F

    got = span_dedup.dedup_spans(docs(spark, data)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    same_rows(got, plain_spans(data))


@pytest.mark.parametrize("data", [rows(), random_rows(3), random_rows(4), []])
def test_suffix_dedup(spark, data):
    from pyspark.sql import functions as F

    got = suffix_dedup.dedup_suffixes(docs(spark, data)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    same_rows(got, plain_bytes(data))


def test_suffix_dedup_in_many_blocks_and_runs(spark):
    data = random_rows(5)
    got = suffix_dedup.dedup_suffixes(docs(spark, data).repartition(17)).select("doc_id", "n_bytes", "n_removed", "n_spans")
    same_rows(got, [r[:4] for r in plain_bytes(data)])


def test_cut_texts_keep_rows_columns_and_valid_text(spark):
    data = [(1, "é" * 90, "a"), (2, "xé" + "é" * 90 + "z", "b"), (3, None, None)]
    frame = docs(spark, data).selectExpr("*", "doc_id * 0 AS n_chars")
    got = {r.doc_id: r for r in suffix_dedup.with_cut_texts(frame).collect()}
    assert suffix_dedup.with_cut_texts(frame).columns == frame.columns
    assert all(r.n_chars == len(r.text) and "�" not in r.text for r in got.values())
    assert (got[2].text, got[2].source, got[3].text) == ("xz", "b", "")


def test_loser_tree_gives_order_and_shared_lengths():
    rnd = random.Random(5)

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for _ in range(300):
        runs = [sorted(bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(0, 9))]
        lengths = [[0, *map(shared, r, r[1:])] for r in runs]
        for run, known in zip(runs, lengths):
            assert lcp_merge.unfold(known, [s[n:] for s, n in zip(run, known)]) == run
        out = list(lcp_merge.merge(runs, lengths))
        merged = [runs[r][i] for r, i, _ in out]
        assert merged == sorted(s for run in runs for s in run)
        assert [n for *_, n in out] == [0] * min(1, len(merged)) + list(map(shared, merged, merged[1:]))


def test_loser_tree_never_reads_known_prefixes():
    reads = []

    class Watched(bytes):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.start)
            return bytes.__getitem__(self, key)

    runs = [[Watched(b"common-prefix-a"), Watched(b"common-prefix-c")], [Watched(b"common-prefix-b"), Watched(b"common-prefix-d")]]
    assert len(list(lcp_merge.merge(runs, [[0, 14], [0, 14]]))) == 4
    assert reads.count(0) == 2 and min(r for r in reads[2:]) >= 14


def test_anchors_depend_on_content_only():
    rnd = np.random.default_rng(1)
    common = rnd.integers(1, 5, 300).astype(np.uint64)
    found = []
    for before in (0, 37, 301):
        items = np.concatenate([rnd.integers(1, 5, before).astype(np.uint64), common, rnd.integers(1, 5, 50).astype(np.uint64)])
        a = winnow.anchors(winnow.Spans(items).grams(10), 10, 60, np.zeros(len(items), np.int64))
        starts = {s: p for p, f, n in zip(a.place.tolist(), a.first.tolist(), a.count.tolist()) for s in range(f, f + n)}
        assert sorted(starts) == list(range(len(items) - 59))
        found.append([starts[before + i] - before for i in range(241)])
    assert found[0] == found[1] == found[2]


def plain_print(text: str | None) -> int:
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(prints: list[int]) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_simhash_components(spark):
    data = rows()
    prints = [plain_print(t) for _, t, _ in data]
    roots = plain_components(prints)
    least = {}
    for (doc, *_), r in zip(data, roots):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    got = simhash_ball.near_duplicates(docs(spark)).select("doc_id", simhash_ball.hex_print(), "component_id")
    same_rows(got, [(d[0], f"{p:016x}", least.get(r)) for d, p, r in zip(data, prints, roots)])
    assert simhash_ball.near_duplicates(empty_docs(spark)).count() == 0
    kept = simhash_ball.one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_every_flip_of_three_bits_meets(spark):
    rnd = random.Random(4)
    signed = simhash_ball._signed
    pairs = []
    for _ in range(60):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(1, 3)):
            b ^= 1 << bit
        pairs.append((a, b))
    frame = spark.createDataFrame([(signed(x),) for p in pairs for x in p], "fp bigint")
    keys = simhash_ball.variants(frame).groupBy("block", "key").agg({"fp": "collect_set"}).where("size(`collect_set(fp)`) > 1")
    met = {frozenset(r[2]) for r in keys.collect()}
    assert all(any({signed(a), signed(b)} <= m for m in met) for a, b in pairs)


def test_large_groups_match_all_pairs():
    rnd = random.Random(3)
    for _ in range(10):
        block = rnd.randrange(4)
        shift, hidden = simhash_ball.BLOCKS[block]
        key = rnd.getrandbits(64) & ~hidden
        visible = [b for b in range(64) if not hidden >> b & 1]
        spread, members = rnd.choice([3, 6, 10, 16]), set()
        while len(members) < 150:
            outer = key if rnd.random() < 0.2 else key ^ (1 << rnd.choice(visible[: rnd.choice([2, 8, 48])]))
            inner = 0
            for _ in range(rnd.randrange(spread)):
                inner ^= 1 << rnd.randrange(16)
            members.add(outer | inner << shift)
        members = sorted(members)
        got = simhash_ball.group_roots(block, key, np.array(members, np.uint64)).tolist()
        assert got == plain_components(members)


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randint(-50, 250), rnd.randint(-50, 250)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    expected = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r.node: r.root for r in got} == expected and len(got) == len(expected)
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("n", [1023, 1024, 1025, 5000])
def test_anchors_of_long_texts_are_found_in_segments(monkeypatch, n):
    items = np.random.default_rng(n).integers(1, 9, n).astype(np.uint64)
    group = np.sort(np.random.default_rng(1).integers(0, 3, n))
    grams = winnow.Spans(items).grams(5)
    whole = winnow.anchors(grams, 5, 20, group)
    kept = (np.uint64(2**64 - 1) >> np.uint64(28)) << np.uint64(28)  # the hash bits that count are the same ones
    monkeypatch.setattr(winnow, "PLACE_BITS", np.uint64(10))
    cut = winnow.anchors(grams & kept | np.uint64(0), 5, 20, group)
    for x, y in ((whole.place, cut.place), (whole.first, cut.first), (whole.count, cut.count)):
        assert x.tolist() == y.tolist()


def thue_morse(bits):
    text = "a"
    for _ in range(bits):
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_words_that_a_polynomial_confuses_are_told_apart(spark):
    one, rest = thue_morse(11), prose(77, 49)
    other = one.translate(str.maketrans("ab", "ba"))
    frame = docs(spark, [(1, f"{one} {rest}", "s"), (2, f"{other} {rest}", "s"), (3, f"{one} {rest}", "s")])
    assert {r.doc_id: r.n_removed for r in span_dedup.dedup_spans(frame).collect()} == {1: 0, 2: 0, 3: 50}


def test_many_repeated_rows_take_linear_time(spark):
    text, late = prose(5, 120), f"{prose(6, 30)} {prose(5, 120)}"
    frame = docs(spark, [(1, text, "s")] * 5000 + [(2, late, "s")] * 5000)
    got = span_dedup.dedup_spans(frame).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 120, 0, 5000), (2, 150, 120, 5000)]
