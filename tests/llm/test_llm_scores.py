import base64
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import CLASHES, docs, empty_docs, prose, rows, same_rows, sha, words

import corpus_pipeline
from tidemark.llm import boosted_trees, chat_trees, compression_rules, decontaminate, kn_toxicity, quality_trees


def held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


# -- quality rules ---------------------------------------------------------------------------------


def plain_rules(text):
    text = text or ""
    w = words(text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if words(line):
            duplicates += line in seen
            seen.add(line)
    counts = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if counts[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    n = len(w)
    return n, sum(map(len, w)), symbols, duplicates, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_rule_counts(spark):
    data = [*rows(), (30, "a b c a b c a\nb\n\na b c a b c a\n \n \nb", "x"), (31, "a b a b a b", "x"), (32, "#1 <b>|&%$*", "x")]
    got = compression_rules.quality_rules(docs(spark, data))
    same_rows(got.select(*got.columns[:7]), [(d, *plain_rules(t)) for d, t, _ in data])
    assert not got.where("base_failed AND kept").count()
    assert compression_rules.quality_rules(empty_docs(spark)).count() == 0


def test_compression_bands(spark):
    rnd = random.Random(1)
    noise = " ".join("".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(20)) for _ in range(200))
    hexes = " ".join(f"{rnd.getrandbits(64):016x}" for _ in range(300))
    varied = " ".join(f"{prose(9, 12)} {i}" for i in range(300))  # repeats without a repeated line being equal
    half = prose(20, 1500) + " " + " ".join(f"{prose(10, 40)} {i}" for i in range(60))
    data = [(1, prose(11, 60), "a"), (2, prose(12, 3000), "a"), (3, varied, "b"), (4, half, "b"), (5, noise, "c"), (6, hexes, "c")]
    got = {r.doc_id: r for r in compression_rules.quality_rules(docs(spark, data)).collect()}
    assert got[1].kept and got[2].kept and not got[3].kept and not got[4].kept
    assert got[3].ratio > compression_rules.band(len(varied))[1]
    assert 0 < compression_rules.compression(b"abc", lambda b: b)[0] == 1.0


def test_incompressible_texts_are_rejected(spark):
    rnd = random.Random(2)

    def noise(alphabet, n_bytes):
        out = ""
        while len(out.encode()) < n_bytes or len(out.split()) < 60:
            out += "".join(rnd.choices(alphabet, k=rnd.randint(2, 9))) + " "
        return out

    han, hangul = [chr(c) for c in range(0x4E00, 0x9FA6)], [chr(c) for c in range(0xAC00, 0xD7A4)]
    printable, letters = [chr(c) for c in range(33, 127)], [chr(c) for c in range(48, 123) if chr(c).isalnum()]
    bad = [noise(a, n) for a in (printable, letters) for n in (500, 1000, 3000, 5000, 20000)]
    bad += [noise(hangul, n) for n in (1000, 5000, 20000)] + [noise(han, n) for n in (5000, 20000)]
    bad += [noise("0123456789abcdef", n) for n in (5000, 20000)]
    bad += ["\n".join(base64.b64encode(rnd.randbytes(12)).decode() for _ in range(n)) for n in (60, 300, 2000)]
    bad += [" ".join("".join(rnd.choices(han, k=20)) for _ in range(200)), " ".join(f"{rnd.getrandbits(64):016x}" for _ in range(300))]
    bad.append(prose(30, 700) + " " + noise(letters, 6000))  # chunks alone tell
    good = [prose(40 + n, n) for n in (50, 60, 120, 250, 500, 1000, 3000)]
    data = [(i, t, "a") for i, t in enumerate(bad + good)]
    got = {r.doc_id: r for r in compression_rules.quality_rules(docs(spark, data)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i in range(len(bad)) if got[i].kept] == []
    assert all(got[len(bad) + i].kept for i in range(len(good)))
    assert got[len(bad) - 1].ratio > compression_rules.band(len(bad[-1]))[0] or got[len(bad) - 1].bad_chunk_percent >= 30


# -- quality trees ---------------------------------------------------------------------------------


def test_boosted_trees_learn_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = boosted_trees.fit(x[:3000], y[:3000])
    assert ((forest.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    one = x[3000]
    total = forest.start
    for t in range(len(forest.feature)):  # the flat arrays, walked one by one
        node = 0
        while node < forest.feature.shape[1]:
            node = 2 * node + 1 + (one[forest.feature[t, node]] > forest.threshold[t, node])
        total += forest.leaf[t, node - forest.feature.shape[1]]
    assert np.isclose(forest.score(one[None])[0], 1 / (1 + np.exp(-total)))
    assert boosted_trees.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (boosted_trees.fit(x, np.ones(4000)).score(x) > 0.9).all()


LABELS = f"doc_id bigint, quality int, toxic int, {CLASHES}"


def labels(spark, data):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES.split(","))) for r in data], LABELS)


def labelled(n: int):
    rnd = random.Random(7)
    data, marks = [], []
    for i in range(n):
        w = prose(1000 + i, rnd.randint(20, 120)).split(" ")
        bad, toxic = rnd.random() < 0.3, rnd.random() < 0.3
        if bad:
            w = [x + rnd.choice(["###", "***"]) for x in w] if rnd.random() < 0.5 else w[:3] * (len(w) // 3)
        if toxic:
            for _ in range(max(1, len(w) // 25)):
                w.insert(rnd.randint(0, len(w)), rnd.choice(["zorgu", "vlaxi"]) + rnd.choice(["", "ti", "er", "on"]))
        data.append((i, " ".join(w), "s"))
        marks.append((i, int(not bad), int(toxic)))
    return data, marks


def accuracy(frame, marks, column: int) -> float:
    truth = {m[0]: m[column] for m in marks}
    got = [r for r in frame.collect() if r.held_out]
    assert len(got) > 50 and all(held(r.doc_id) for r in got)
    return sum(r.predicted == truth[r.doc_id] for r in got) / len(got)


def test_held_out_accuracy(spark):
    data, marks = labelled(800)
    assert accuracy(quality_trees.quality_scores(docs(spark, data), labels(spark, marks)), marks, 1) > 0.95
    assert accuracy(kn_toxicity.toxicity_scores(docs(spark, data), labels(spark, marks)), marks, 2) > 0.93
    kept = kn_toxicity.without_toxic(docs(spark, data), labels(spark, marks))
    gone = {d for d, *_ in data} - {r.doc_id for r in kept.collect()}
    scores = kn_toxicity.toxicity_scores(docs(spark, data), labels(spark, marks))
    assert kept.columns == docs(spark).columns and gone == {r.doc_id for r in scores.where("predicted = 1").collect()}


def test_labels_of_held_out_rows_are_not_learned(spark):
    data, marks = labelled(150)
    flipped = [(d, 1 - q, 1 - t) if held(d) else (d, q, t) for d, q, t in marks]
    for score in (quality_trees.quality_scores, kn_toxicity.toxicity_scores):
        a, b = (score(docs(spark, data), labels(spark, m)).collect() for m in (marks, flipped))
        assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_scores_of_odd_rows(spark):
    odd = [(None, 1, 1), (5, None, None), (5, 1, 0), (5, 0, 1), (5, 1, 1), (4, 0, 0), (7, 1, 0), (7, 1, 0)]
    for score in (quality_trees.quality_scores, kn_toxicity.toxicity_scores):
        for marks in (odd, []):
            got = score(docs(spark), labels(spark, marks)).collect()
            assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r[0] for r in rows())))
            assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in got)
        assert score(empty_docs(spark), labels(spark, odd)).count() == 0


def test_five_gram_keys_follow_the_words():
    key, word, sizes = kn_toxicity.keys_of(["ab", "中", "abcdef"])
    assert sizes.tolist() == [3, 2, 7] and word.tolist() == [0] * 3 + [1] * 2 + [2] * 7
    code = {c: i for c, i in zip("\x01\x02abcdef", (1, 2, *range(97, 103)))}

    def packed(text):
        out = 0
        for c in text:
            out = out << 12 | code[c]
        return out

    assert key[:3].tolist() == [packed(t) for t in ("\x01a", "\x01ab", "\x01ab\x02")]
    assert key[-2:].tolist() == [packed("bcdef"), packed("cdef\x02")]


class PlainKneserNey:
    """Both classes' models in plain Python, from (word, class or None) pairs."""

    def __init__(self, uses):
        self.counts = {k: {} for k in range(2, 6)}  # level -> gram -> [ordinary, toxic]
        for word, label in uses:
            framed = f"\x01{word}\x02"
            for i in range(1, len(framed)):
                gram = framed[max(0, i - 4) : i + 1]
                own = self.counts[len(gram)].setdefault(gram, [0, 0])
                if label is not None:
                    own[label] += 1
        self.ways = {}
        for k in range(4, 1, -1):
            starts = set(self.counts[k])
            for longer, n in self.counts[k + 1].items():
                cell = self.counts[k].setdefault(longer[1:], [0, 0])
                cell[0] += n[0] > 0
                cell[1] += n[1] > 0
                if k == 2:
                    self.ways[longer[1:]] = self.ways.get(longer[1:], 0) + 1
            if k == 2:
                for g in starts:
                    self.ways[g] = self.ways.get(g, 0) + 1

    def chance(self, gram, label):
        if len(gram) == 2:
            row = {g: n for g, n in self.ways.items() if g[0] == gram[0]}
            return (max(row.get(gram, 0) - 0.75, 0) + 0.75 * len(row) / 256) / sum(row.values()) if row else 1 / 256
        row = [n[label] for g, n in self.counts[len(gram)].items() if g[:-1] == gram[:-1] and n[label]]
        below = self.chance(gram[1:], label)
        if not row:
            return below
        own = self.counts[len(gram)].get(gram, [0, 0])[label]
        return max(own - 0.75, 0) / sum(row) + 0.75 * len(row) / sum(row) * below

    def value(self, word):
        framed, total = f"\x01{word}\x02", 0.0
        for i in range(2, len(framed)):
            gram = framed[max(0, i - 4) : i + 1]
            total += np.log(self.chance(gram, 1) / self.chance(gram, 0))
        return np.log1p(kn_toxicity.TOXIC_SHARE * (np.exp(np.clip(total, -30, 30)) - 1))


def test_class_chances_sum_to_one():
    model = PlainKneserNey([(w, 1) for w in ("zorg", "zorgu", "the")] + [(w, 0) for w in ("the", "then", "ore", "zen")] + [("zebra", None)])
    letters = [chr(i) for i in range(256)]
    for label in (0, 1):
        for context in ("\x01zor", "\x01th", "or", "rg", "z", "hen", "ebr"):
            assert sum(model.chance(context + c, label) for c in letters) == pytest.approx(1.0)
    assert model.value("zorg") > 0 > model.value("ore")


@pytest.mark.parametrize("model_rows", [1 << 20, 0])
def test_scores_equal_plain_kneser_ney(spark, model_rows):
    data, marks = labelled(150)
    label = {i: t for i, _, t in marks if not held(i)}
    calibrate = {i for i in label if zlib.crc32(str(i).encode()) // 5 % 5 == 0}
    texts = {i: kn_toxicity.words_of(t) for i, t, _ in data}
    model = PlainKneserNey([(w, label.get(i) if i not in calibrate else None) for i, ws in texts.items() for w in ws])
    worth = {w: model.value(w) for ws in texts.values() for w in ws}
    mean = {i: sum(worth[w] for w in ws) / len(ws) if ws else 0.0 for i, ws in texts.items()}
    z = {i: np.log1p(max(m / kn_toxicity.TOXIC_SHARE, kn_toxicity.LOWEST)) for i, m in mean.items()}
    used = sorted(i for i in calibrate if texts.get(i))
    a, b = kn_toxicity.logistic(np.array([z[i] for i in used]), np.array([float(label[i]) for i in used]))
    got = kn_toxicity.toxicity_scores(docs(spark, data), labels(spark, marks), model_rows=model_rows).collect()
    for r in got:
        assert r.score == pytest.approx(1 / (1 + np.exp(-(a + b * z[r.doc_id]))), abs=1e-6)
    assert len({round(r.score, 3) for r in got}) > 10


def test_toxicity_keeps_every_gram(spark):
    rnd = random.Random(9)
    data, marks = [], []
    for i in range(400):
        toxic = rnd.random() < 0.3
        w = prose(7000 + i, rnd.randint(20, 60)).split(" ")
        if toxic:
            w[rnd.randrange(len(w))] = "vex" + "".join(rnd.choices("aeiouklm", k=6))  # each of them once
        data.append((i, " ".join(w), "s"))
        marks.append((i, 1, int(toxic)))
    frame, judged = docs(spark, data), labels(spark, marks)
    ways = ({}, {"model_rows": 0}, {"model_rows": 0, "top_words": 3})
    sent, *joined = ({r.doc_id: r.score for r in kn_toxicity.toxicity_scores(frame, judged, **way).collect()} for way in ways)
    for other in joined:
        assert sent.keys() == other.keys() and all(abs(sent[k] - other[k]) < 1e-9 for k in sent)
    for way in ({}, {"top_words": 3}):
        kept = {r.doc_id for r in kn_toxicity.without_toxic(frame, judged, **way).collect()}
        assert kept == {k for k, v in sent.items() if v < 0.5}
    # Words are valued as by a walk over the whole tables.
    cut = [kn_toxicity.words_of(t) for _, t, _ in data]
    words = sorted({w for ws in cut for w in ws})
    counts = {w: [0, 0] for w in words}
    for ws, (_, _, toxic) in zip(cut, marks):
        for w in ws:
            counts[w][toxic] += 1
    grams = {}
    for w in words:
        for k in kn_toxicity.keys_of([w])[0].tolist():
            g = grams.setdefault(k, [0, 0])
            g[0] += counts[w][0]
            g[1] += counts[w][1]
    counted = spark.createDataFrame([(k, *v) for k, v in grams.items()], "gram bigint, ordinary bigint, toxic bigint")
    seen, contexts = kn_toxicity.ratios(spark, counted)
    own, weight = ({r.key: r.value for r in t.collect()} for t in (seen, contexts))
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    got = {r.word: r.value for r in kn_toxicity.word_values(frame, kn_toxicity.gram_values(counted, seen, contexts)).collect()}
    for w in words:
        total = 0.0
        for key in kn_toxicity.keys_of([w])[0].tolist():
            for k in range(5, 2, -1):
                if key >> (12 * (k - 1)) > 0:
                    gram = key & ((1 << (12 * k)) - 1)
                    if kn_toxicity.tagged(gram, k) in own:
                        total += own[kn_toxicity.tagged(gram, k)]
                        break
                    total += weight.get(kn_toxicity.tagged(gram >> 12, k), 0.0)
        assert abs(got[w] - np.log1p(kn_toxicity.TOXIC_SHARE * (np.exp(np.clip(total, -30, 30)) - 1))) < 1e-9


# -- decontamination -------------------------------------------------------------------------------


def plain_shingles(text, low=decontaminate.LOWER):
    w, now = [], []
    for b in (text or "").encode() + b" ":
        if decontaminate.IN_WORD[b]:
            now.append(int(low[b]))
        elif now:
            w.append(tuple(now))
            now = []
    return w


def test_decontamination_matches_all_windows(spark):
    rnd = random.Random(3)
    items = [(i, f"{prose(500 + i, rnd.randint(12, 40))}. {prose(600 + i, rnd.randint(2, 9))}") for i in range(60)]
    items += [(100, "tiny"), (101, None), (102, ""), (None, prose(700, 20)), (0, items[0][1])]
    data = []
    for i in range(120):
        w = prose(2000 + i, rnd.randint(0, 300)).split(" ")
        if i % 3 == 0:
            leak = rnd.choice(items[:60])[1].split(" ")
            if i % 2:
                leak[rnd.randrange(len(leak))] = "altered"
            at = rnd.randint(0, len(w))
            w[at:at] = leak
        data.append((1000 + i, " ".join(w).upper() if i % 7 == 0 else " ".join(w), "s"))
    data += rows()
    bench = spark.createDataFrame([(*r, "x", "x") for r in items], "item_id bigint, text string, doc_id string, score string")
    longest = max(len(plain_shingles(t)) for _, t in items)
    expected = []
    for doc, text, _ in data:
        w = plain_shingles(text)
        for item, t in items:
            q = plain_shingles(t)
            if not q:
                continue
            k = min(5, len(q))
            wanted = {tuple(q[i : i + k]) for i in range(len(q) - k + 1)}
            begins = range(0, max(len(w) - longest, 1), longest) if w else ()
            best = max((len(wanted & {tuple(w[i : i + k]) for i in range(b, min(b + 2 * longest, len(w)) - k + 1)}) / len(wanted) for b in begins), default=0)
            if best >= 0.8:
                expected.append((doc, item, round(best, 6)))
    for size in (2048, 7):
        got = decontaminate.contaminated(docs(spark, data), bench, size)
        same_rows(got.selectExpr("doc_id", "item_id", "round(overlap, 6)"), expected)
        assert got.where("score < 0.6 OR score > 1.000001 OR question_overlap > 1 OR answer_overlap > 1").count() == 0
    kept = decontaminate.without_contaminated(docs(spark, data), bench)
    left = Counter(d for d, *_ in data)
    assert kept.columns == docs(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: n for d, n in left.items() if d not in {e[0] for e in expected}})
    assert decontaminate.contaminated(empty_docs(spark), bench).count() == 0
    assert decontaminate.contaminated(docs(spark), bench.limit(0)).count() == 0


def test_decontamination_in_runs_and_passes_equals_one_sweep(spark, monkeypatch):
    """Long texts in short runs, words in small pieces, long items in indexes of their own, a pass for each index."""
    items = [(i, f"{prose(500 + i, 8 + i)}. {prose(600 + i, 5)}") for i in range(40)] + [(90, prose(90, 300)), (91, prose(91, 90))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    data = [(i, " ".join([prose(3000 + i, 200), items[i][1], "w" * 90, prose(4000 + i, 800), items[-1 - i % 3][1]]), "s") for i in range(20)]
    data += [(99, "x" * 5000, "s"), (98, None, "s")]
    frame = docs(spark, data)
    words = decontaminate.Words([t or "" for _, t, _ in data])
    want = sorted(map(tuple, decontaminate.contaminated(frame, bench).selectExpr("doc_id", "item_id", "round(score, 6)", "overlap").collect()))
    assert {(i, items[i][0]) for i in range(20)} | {(i, items[-1 - i % 3][0]) for i in range(20)} <= {r[:2] for r in want}
    for name, value in (("HASHED_BYTES", 64), ("RUN_WORDS", 500), ("RUN_SUMS", 300), ("INDEX_WORDS", 256), ("HELD_BYTES", 1)):
        monkeypatch.setattr(decontaminate, name, value)
    pieces = decontaminate.Words([t or "" for _, t, _ in data])
    assert (pieces.hashes == words.hashes).all() and (pieces.first == words.first).all()
    groups = list(decontaminate.index_groups(bench, 8))
    sizes = sorted(len(i.value.ids) for g in groups for i in g)
    assert all(len(g) == 1 for g in groups) and sum(sizes) == len(items) and sizes[-1] <= 8 and sizes[:2] == [1, 1]
    found = [
        (data[t][0], index.value.ids[i], round(score, 6), whole)
        for g in groups for index in g for t, i, score, whole, _, _ in index.value.search(pieces)
    ]
    assert sorted(found) == want
    kept = decontaminate.without_contaminated(frame, bench, 8)
    assert {r.doc_id for r in kept.collect()} == {98, 99} | set(range(20)) - {r[0] for r in want}


def test_text_between_question_and_answer(spark, tmp_path):
    items = [(i, f"{prose(800 + i, 8 + i % 6)}? {prose(900 + i, 6)}.") for i in range(30)] + [(90, f"{prose(990, 14)}? --"), (91, prose(991, 15))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    data, expected = [], set()
    for i, text in items[:30]:
        q, a = decontaminate.question_and_answer(text)
        for k, between in enumerate(("Answer:", "xa xb xc xd xe xf xg xh xi xj", "12")):
            for shift in range(0, 20, 5):
                data.append((1000 * i + 100 * k + shift, f"{prose(3000 + i, 40 + shift)}\n{q} {between} {a}\n{prose(4000 + i, 60)}", "s"))
                expected.add((data[-1][0], i))
        data.append((1000 * i + 900, f"{prose(5000 + i, 40)} {q} {prose(6000 + i, 60)}", "s"))  # the question alone
    data += [(90_000, f"{prose(1, 30)} {items[30][1]} {prose(2, 30)}", "s"), (91_000, f"{prose(3, 30)} {items[31][1]} {prose(4, 30)}", "s")]
    expected |= {(90_000, 90), (91_000, 91)}
    frame = docs(spark, data)
    got = decontaminate.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    assert all(r.overlap >= 0.8 or min(r.question_overlap, r.answer_overlap) >= 0.8 for r in got)
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.drop_contaminated(spark, frame, str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {d[0] for d in data} - {d for d, _ in expected}


def test_question_and_answer():
    split = decontaminate.question_and_answer
    assert split("What is it? A stone.") == ("What is it? ", "A stone.")
    assert split("Line one\nLine two") == ("Line one\n", "Line two")
    assert split("only") == ("only", "only") and split("") == ("", "")


# -- chat trees ------------------------------------------------------------------------------------

MESSAGES = "tree string, id bigint, parent bigint, score double, role string, text string, leaf string, up string, total string, piece string"


def messages(spark, data):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in data], MESSAGES)


def test_best_branches_and_masks(spark):
    data = [
        ("a", 1, None, 1.0, "user", "q & <|im_end|>"), ("a", 2, 1, 0.2, "assistant", "weak"), ("a", 3, 1, 0.9, "assistant", "&lt;| good"),
        ("a", 4, 3, 0.5, "user", None), ("a", 5, 3, 0.5, "us\ner", "tie\n"), ("a", 6, 2, None, None, "deep"),
        ("b", 1, 99, 1.0, "assistant", "orphan"), ("c", 1, 2, 1.0, "user", "x"), ("c", 2, 1, 1.0, "user", "y"), ("d", 1, 1, 1.0, "user", "self"),
    ]
    out = {(r.tree, r.leaf): r for r in chat_trees.parse_back(chat_trees.format_paths(messages(spark, data), 2)).collect()}
    assert set(out) == {("a", 4), ("a", 5), ("b", 1)}  # cycles belong to no path; ties go to the smaller leaf
    assert [(t.role, t.text) for t in out["a", 5].turns] == [("user", "q & <|im_end|>"), ("assistant", "&lt;| good"), ("us\ner", "tie\n")]
    assert out["a", 4].learned == "&lt;| good" and out["b", 1].learned == "orphan"
    assert out["a", 4].formatted.count("<|im_start|>") == 3
    assert chat_trees.format_paths(messages(spark, []), 1).count() == 0


@pytest.mark.parametrize("length", [1, 2, 7, 40])
def test_long_paths_keep_their_order(spark, length):
    data = [("t", i, i - 1 if i else None, 1.0, "assistant" if i % 2 else "user", f"m{i}") for i in range(length)]
    data += [("u", i, i - 1 if i else None, 1.0, "user", f"n{i}") for i in range(3)]
    out = {r.tree: r for r in chat_trees.parse_back(chat_trees.format_paths(messages(spark, data))).collect()}
    assert [t.text for t in out["t"].turns] == [f"m{i}" for i in range(length)]
    assert out["t"].learned == "".join(f"m{i}" for i in range(1, length, 2))
    assert [t.text for t in out["u"].turns] == ["n0", "n1", "n2"]


def test_conversations_with_odd_rows(spark, tmp_path):
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_start|>"), (1, 1, "assistant", "yo <|im_start|>"), (2, None, None, None),
        (None, 0, "user", "lost"), (None, 1, "assistant", None), (3, 5, "system", ""), (3, -1, "assistant", "é中"),
    ]
    spark.createDataFrame([(*r, "x") for r in data], "conv_id bigint, turn bigint, role string, text string, id string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat_trees.op8_chat_trees(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, None, -1} and got[1].n_turns == 3
    assert got[1].turns_sha256 == sha(("user\nhi\n" + "assistant\nyo <|im_start|>\n" * 2).encode())
    assert (got[1].loss_chars, got[1].loss_sha256) == (30, sha(("yo <|im_start|>" * 2).encode()))
    assert (got[3].loss_chars, got[3].turns_sha256) == (2, sha("assistant\né中\nsystem\n\n".encode()))
    assert got[2].turns_sha256 == sha(b"\n\n") and got[None].loss_chars == 0
    probe = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].loss_sha256 == sha(probe.encode()) and got[-1].loss_chars == len(probe)
