"""Source divergence, WARC archives and centroids: plain versions, round trips, odd rows."""

import math
import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from llm_cases import docs, prose, same_rows

from tidemark.llm import centroids, source_divergence, warc_segments
from tidemark.session import fresh_path

TERM_BYTES = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))


# --- source divergence


def plain_terms(text):
    out, held = [], bytearray()
    for b in (text or "").encode() + b" ":
        if b in TERM_BYTES:
            held.append(b + 32 if 65 <= b <= 90 else b)
        elif held:
            out.append(held.decode())
            held = bytearray()
    return out


def plain_divergence(rows, least=3, ranks=200):
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        in_docs, counts = Counter(), defaultdict(Counter)
        for t, _, s in own:
            terms = plain_terms(t)
            in_docs.update(set(terms))
            counts[s].update(terms)
        kept = [t for t, n in in_docs.items() if n >= least]
        v = len(kept)
        whole = Counter({t: sum(c[t] for c in counts.values()) for t in kept})

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + v)

        sources = {r[2] for r in own}
        for a in sources:
            found = [("pair", b, sum((share(counts[a], t) - share(counts[b], t)) ** 2 // share(counts[b], t) for t in kept)) for b in sources - {a}]
            found += [
                ("term", t, (share(counts[a], t) - share(whole, t)) ** 2 // share(whole, t))
                for t in kept if counts[a][t] and share(counts[a], t) > share(whole, t)
            ]
            for part in ("pair", "term"):
                order = sorted((f for f in found if f[0] == part), key=lambda f: (-f[2], f[1].encode()))
                out += [(lang, a, *f, i) for i, f in enumerate(order, 1) if part == "pair" or i <= ranks]
    return out


def language_rows():
    rnd = random.Random(3)
    words = ["a", "B", "the", "The", "é", "É", "ß", "中文", "x1y", "don't", "zz", "q", "mid-dle", "\x00n", "K"]
    rows = [
        (" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))), lang, source)
        for lang, source in product(["en", "de", None], ["s1", "s2", "s3", None]) for _ in range(4)
    ]
    rows += [("copy of the text", "en", "s1")] * 5 + [("copy of the text", "en", "s2")] * 2 + [("copy of the text", "de", "s2")]
    rows += [("", "fr", "s1"), (None, "fr", "s2"), ("only here", "it", "s9"), ("123 456", "en", "no terms"), ("é É K", "en", "s3")]
    return rows


def as_docs(spark, rows):
    return docs(spark, [(i, t, s) for i, (t, _, s) in enumerate(rows)]).drop("lang").join(
        spark.createDataFrame([(i, lang) for i, (_, lang, _) in enumerate(rows)], "doc_id bigint, lang string"), "doc_id"
    )


@pytest.mark.parametrize("ranks", [200, 3])
def test_divergence_equals_plain_version(spark, ranks):
    rows = language_rows()
    got = source_divergence.divergence(as_docs(spark, rows), term_ranks=ranks)
    same_rows(got.select("lang", "source", "part", "item", "value", "rank"), plain_divergence(rows, ranks=ranks))


def test_shares_beyond_a_long_are_exact(spark):
    rows = [(9_223_372_034, 10**12, 7), (9_223_372_035, 10**12, 7), (0, 0, 1), (4 * 10**12, 5 * 10**13, 10**6), (0, 0, 0)]
    got = spark.createDataFrame(rows, "n long, t long, k long").select(source_divergence.share("n", "t", "k").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // (t + k) if t + k else None for n, t, k in rows]


def test_divergence_of_no_documents(spark):
    assert source_divergence.divergence(as_docs(spark, language_rows()).limit(0)).count() == 0


def test_long_text_is_cut_between_terms():
    text = ("wörd " * 500_000 + "x" * 3_000_000 + " end").encode()
    parts = list(source_divergence.pieces(text))
    assert len(parts) > 2
    assert Counter(t for p in parts for t in p) == {"wörd".encode(): 500_000, b"x" * 3_000_000: 1, b"end": 1}


def test_repeated_text_is_tokenised_once(spark, monkeypatch):
    rows = [(f"same text of {i % 3}", "en", f"s{i % 4}") for i in range(60)]
    counts = source_divergence.term_counts(as_docs(spark, rows))
    assert counts.where("term = 'same'").agg({"n": "sum", "docs": "sum"}).head()[:] == (60, 60)
    assert "first" in counts._jdf.queryExecution().optimizedPlan().toString()


# --- WARC archives


def page_rows():
    page, rnd = prose(30, 9000), random.Random(4)
    noise = "".join(chr(rnd.choice([13, 10, 0, 65, 233, 20013])) for _ in range(60000))
    return [
        (5, "http://b/", page), (2, "http://a/", page), (9, "http://c/", page), (1, "http://x/", ""), (3, None, None), (4, "u", ""),
        (6, "http://n/\r\nWARC/1.1 ü", noise), (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\nabc"), (8, "u", "\r\n\r\n"),
        (10, "u", "twice"), (10, "u", "twice"), (10, "u", "twice"), (11, "u", "twice"), (None, "u", "no id"), (None, None, "no id"),
        (12, "u", "no id"), (-4, "u", prose(31, 40000)),
    ]


def as_pages(spark, rows):
    names = "page_id bigint, url string, html string, digest string, payload string, block string, copy string, n string, type string, row string"
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], names)


def plain_pages(rows, revisit_from=0):
    groups = defaultdict(list)
    for page_id, url, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        about = (len(payload), warc_segments.sha1_base32(payload))
        if len(payload) < revisit_from:
            out += [(i, *about, "response", None) for i in ids]
        else:
            out += [(ids[0], *about, "response", None)] + [(i, *about, "revisit", ids[0]) for i in ids[1:]]
    return out


@pytest.mark.parametrize("revisit_from, segment, chunk", [(0, 16384, 4096), (0, 300, 7), (6, 1000, 100000)])
def test_archives_round_trip(spark, revisit_from, segment, chunk):
    path = fresh_path(spark, "warc")
    rows = page_rows()
    warc_segments.write_archives(as_pages(spark, rows), path, revisit_from, archive_records=20, segment_bytes=segment, chunk_bytes=chunk)
    same_rows(warc_segments.page_records(spark, path), plain_pages(rows, revisit_from))
    whole = {r.page_id: bytes(r.payload).decode() for r in warc_segments.read_pages(spark, path).where("type = 'response' and page_id is not null").collect()}
    assert all(whole[i] == (html or "") for i, _, html in rows if i in whole)
    archives = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert len(archives) > 1 and all(len(list(warc_segments.parse(a))) <= 20 for a in archives)


def test_archives_of_no_pages(spark):
    path = fresh_path(spark, "warc")
    warc_segments.write_archives(as_pages(spark, []), path)
    assert warc_segments.page_records(spark, path).collect() == []


def test_many_repeated_rows_are_numbered(spark):
    plan = warc_segments.planned(as_pages(spark, [(1, "u", "a")] * 2501))
    assert sorted(r.copy for r in plan.where("payload is null").select("copy").collect()) == list(range(1, 2501))


def parts_of(*segments):
    return [{"segment": n, "total": total, "block": block} for n, total, block in segments]


def test_segments_are_ordered_and_verified():
    joined = warc_segments.joined
    assert joined(parts_of((2, None, b"b"), (3, 3, b"c"), (1, None, b"a"))) == b"abc"
    assert joined(parts_of((2, 2, b"b"), (1, None, b"a"), (2, 2, b"b"))) == b"ab"
    assert joined(parts_of((1, None, b"a"), (3, 3, b"c"))) is None  # a hole
    assert joined(parts_of((2, 2, b"b"))) is None  # no first record
    assert joined(parts_of((1, None, b"a"), (2, 9, b"b"))) is None  # wrong length
    assert joined(parts_of((1, None, b"a"), (2, None, b"b"))) is None  # no last record


def test_transfer_framing():
    for payload, size in product((b"", b"a", b"\r\n0\r\n\r\n", bytes(1000)), (1, 3, 4096)):
        assert warc_segments.unchunked(warc_segments.chunked(payload, size)) == payload
    assert warc_segments.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert warc_segments.unchunked(b"5\r\nabc") is None
    assert warc_segments.unchunked(b"zz\r\nabc") is None
    assert warc_segments.http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
    assert warc_segments.http_payload(b"no header") is None


def test_damaged_records_have_no_payload(spark):
    path = fresh_path(spark, "warc")
    record = warc_segments._record
    block = warc_segments.HTTP_HEAD + warc_segments.chunked(b"hello", 2)
    digest = f"sha1:{warc_segments.sha1_base32(b'hello')}"
    records = [
        record("response", "<urn:a>", block, [("WARC-Page-ID", 1), ("WARC-Payload-Digest", digest)]),
        record("response", "<urn:b>", block, [("WARC-Page-ID", 2), ("WARC-Payload-Digest", "sha1:OTHER")]),
        record("response", "<urn:c>", block[:-8], [("WARC-Page-ID", 3), ("WARC-Payload-Digest", digest)]),
        record("response", "<urn:d>", block[:40], [("WARC-Page-ID", 4), ("WARC-Payload-Digest", digest), ("WARC-Segment-Number", 1)]),
        record("revisit", "<urn:e>", b"", [("WARC-Page-ID", 5), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", "<urn:a>")]),
        record("revisit", "<urn:f>", b"", [("WARC-Page-ID", 6), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", "<urn:gone>")]),
        record("warcinfo", "<urn:g>", b"software: x\r\n", []),
    ]
    spark.createDataFrame([(r.decode(),) for r in records], "value string").write.option("lineSep", warc_segments.END).text(path)
    good = (5, digest[5:])
    same_rows(warc_segments.page_records(spark, path), [
        (1, *good, "response", None), (2, None, None, "response", None), (3, None, None, "response", None), (4, None, None, "response", None),
        (5, *good, "revisit", 1), (6, None, None, "revisit", None),
    ])
    with pytest.raises(ValueError):
        list(warc_segments.parse(records[0][:-1]))


# --- centroids


def vector_rows():
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(64)]) for i in range(60)]
    rows += [(i + 100, [rnd.choice([-0.25, 0.25]) for _ in range(64)]) for i in range(20)] + [rows[3], rows[3], (200, rows[4][1]), (None, rows[5][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 63), (303, [0.0] * 65), (304, [None] + [0.0] * 63), (305, [math.nan] + [0.0] * 63)]
    rows += [(306, [-math.inf] + [0.0] * 63), (307, [3e38] * 64), (308, [-3e38] * 64), (309, [0.0] * 64), (310, [0.0] * 64)]
    return rows


def as_vectors(spark, rows):
    names = "vec_id bigint, embedding array<double>, v string, cluster string, near string, distance string, centroid string"
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], names)


def integers(rows):
    held = centroids.HELD
    return [
        (i, [max(-held, min(held, math.floor(64 * x))) for x in v]) for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]


@pytest.mark.parametrize("clusters, rounds", [(16, 3), (4, 2), (200, 1)])
def test_clusters_equal_plain_version(spark, clusters, rounds):
    rows = vector_rows()
    got = centroids.cluster(as_vectors(spark, rows), clusters, rounds)
    expected = [(i, k, d, s, t, list(c)) for i, k, d, s, t, c in centroids.plain_clusters(integers(rows), clusters, rounds)]
    limit = 1 << 63
    expected = [(i, k, d, s if s < limit else None, t if t < limit else None, c) for i, k, d, s, t, c in expected]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, expected))


def test_clusters_of_no_vectors(spark):
    got = centroids.cluster(as_vectors(spark, [(1, None), (2, [1.0])]))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and got.count() == 0


def test_ties_go_to_the_smaller_cluster(spark):
    import hashlib

    first, second = sorted((1, 2), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    rows = [(first, [1.0] * 64), (second, [-1.0] * 64), (90, [0.0] * 64)]
    chosen = sorted((1, 2, 90), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:2]
    got = {r.vec_id: r.cluster for r in centroids.cluster(as_vectors(spark, rows), 2, 0).collect()}
    plain = {r[0]: r[1] for r in centroids.plain_clusters(integers(rows), 2, 0)}
    assert got == plain and got[chosen[0]] == 0
