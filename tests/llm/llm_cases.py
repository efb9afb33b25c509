"""Small tables with every odd case, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = "version string, fp string, root string, block string, row string, at string, n string, label string, content string, score string, kept string, anchor string, _version string, keep_id string, keep_version string, doc string, `a.b` string"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    parts = ["the", "an", "ti", "on", "er", "ou", "re", "ha", "ß", "é", "in", "st"]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    """(doc_id, text, source): copies, near copies, shared passages, nulls, repeats, odd texts."""
    base, passage = prose(1, 150), prose(2, 80)
    near = base.split(" ")
    near[70] = "changed"
    late = f"{prose(3, 60)} {passage} {prose(4, 30)}"
    out = [
        (5, base, "a"), (1, base, "a"), (9, base, None), (4, " ".join(near), "a"), (7, late, "b"),
        (6, f"{prose(5, 20)}\n{passage}", "b"), (8, passage + " " + passage, "b"), (10, "", "c"), (11, None, "c"),
        (12, " \t\n ", "c"), (13, "one", "c"), (14, "one two", "c"), (None, base, "d"), (None, None, None),
        (15, late, "e"), (15, late, "e"), (16, prose(6, 130), "e"), (16, prose(7, 130) + " " + base, "e"),
        (17, "ab" * 400, "f"), (18, "word " * 300, "f"), (19, "Ünïcödé Σας 中文 <|endoftext|> don'tİ \x00 x²", "f"),
        (20, prose(8, 30000), "g"), (21, prose(8, 200), "g"), (22, "x" * 70000, "g"), (-3, passage, "h"),
    ]
    return out


def docs(spark, data=None):
    """The rows with further columns whose names clash with those the operators use inside."""
    data = rows() if data is None else data
    extra = ["x"] * len(CLASHES.split(","))
    return spark.createDataFrame([(*r, *extra) for r in data], f"doc_id bigint, text string, source string, {CLASHES}")


def empty_docs(spark):
    return docs(spark, [])


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def same_rows(frame, expected: list[tuple]) -> None:
    got = sorted(map(tuple, frame.collect()), key=repr)
    assert got == sorted(map(tuple, expected), key=repr)
