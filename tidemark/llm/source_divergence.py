"""Divergence of the sources of each language, on exact integer term statistics.

Identical texts of a language are collapsed to one, with their number per source, and tokenised
once; document frequencies and counts are added with these weights. Pairs of sources are then
evaluated sparsely: the sum over all kept terms is taken apart into terms that both sources
have (one join by term), terms that one of them has (its histogram of counts), and the rest
(their number), so no source is filled up with the terms that it lacks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, read, slices

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")  # of UTF-8 bytes: ASCII letters and all beyond ASCII
GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
PIECE_BYTES = 1 << 20  # of a text, tokenised at a time
HELD_TERMS = 500_000  # sums kept by a task before they are handed on
LEAST_DOCS, TERM_RANKS, UNIT = 3, 200, 1_000_000_000
LONG_COUNT = (1 << 63) // UNIT - 1  # counts below it give products that fit a long
COUNTS_SCHEMA = "lang string, source string, term binary, n long, docs long"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, about a megabyte of it at a time, cut between terms."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE_BYTES)
        end = gap.start() if gap else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents), summed over as many texts as memory allows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                 pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in slices(batches, "text"):
        for lang, copies, text in zip(*(batch.column(c) for c in ("lang", "copies", "text"))):
            total: Counter = Counter()
            for terms in pieces(text.as_buffer().to_pybytes()):
                total.update(terms)
            for copy in copies.as_py():
                n, docs = held.setdefault((lang.as_py(), copy["source"]), (Counter(), Counter()))
                times = copy["copies"]
                if times == 1:
                    n.update(total)
                    docs.update(total.keys())
                else:
                    for t, c in total.items():
                        n[t] += c * times
                        docs[t] += times
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of every term of every (lang, source)."""
    lang, source, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    rows = docs.select(lang, source, text).withColumn("content", F.unhex(F.sha2("text", 256)))
    copies = (
        rows.groupBy("lang", "content", "source").agg(F.count("*").alias("copies"))
        .groupBy("lang", "content").agg(F.collect_list(F.struct("source", "copies")).alias("copies"))
    )
    texts = rows.groupBy("lang", "content").agg(F.first("text").alias("text"))  # partial: copies of a task move once
    return (
        texts.join(copies, ["lang", "content"]).select("lang", "copies", F.col("text").cast("binary").alias("text"))
        .mapInArrow(_count_terms, COUNTS_SCHEMA)
        .groupBy("lang", "source", F.col("term").cast("string").alias("term"))
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def share(n: Column | str, total: Column | str, kinds: Column | str) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + kinds)), exact; null where there are no terms."""
    n, total, kinds = (F.col(c) if isinstance(c, str) else c for c in (n, total, kinds))
    below = F.when(total + kinds > 0, total + kinds)
    in_long = F.call_function("div", (n + 1) * UNIT, below)
    beyond = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return F.when(n < LONG_COUNT, in_long).otherwise(beyond) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of longs of at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each (lang, source) is from others and from its language.

    ``docs`` has text, lang and source, nulls of which count as empty; other columns are ignored.
    Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased; a language
    keeps those in ``least_docs`` of its documents. Part ``pair`` has every other source of the
    language, part ``term`` the ``term_ranks`` kept terms that the group uses most above its
    language. Repeated rows count as documents. Ties go to the smaller item. A language without
    kept terms has pairs of value 0; an empty table gives an empty result. Long texts are
    tokenised piece by piece.
    """
    spark = docs.sparkSession
    every = Window.partitionBy("lang", "term")
    counts = (
        term_counts(docs)
        .withColumn("in_docs", F.sum("docs").over(every)).withColumn("n_lang", F.sum("n").over(every))
        .withColumn("first", (F.col("source") == F.min("source").over(every)).cast("int"))
        .where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "n_lang", "first")
    )
    kept = materialise(spark, counts, "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("first").alias("firsts"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    in_lang = Window.partitionBy("lang")
    filled = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "kinds", "firsts"])
    groups = filled.select(
        "lang", "source", "total", "kinds", F.sum("firsts").over(in_lang).alias("v"), F.sum("total").over(in_lang).alias("total_lang"),
    ).withColumn("p0", share(F.lit(0), "total", "v"))
    groups = materialise(spark, groups, "groups")
    scored = kept.join(groups.drop("kinds"), ["lang", "source"]).select(
        "lang", "source", "term", "n", "p0", share("n", "total", "v").alias("p"), share("n_lang", "total_lang", "v").alias("q"),
    )

    terms = scored.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= term_ranks)
    pairs = pair_values(groups, scored).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))


def pair_values(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of different sources of a language."""
    one, two = "lang source kinds v p0".split(), "lang source kinds p0".split()
    a = groups.select(*[F.col(c).alias(c if c in ("lang", "v") else f"{c}_a") for c in one])
    b = groups.select(*[F.col(c).alias(c if c == "lang" else f"{c}_b") for c in two])
    pairs = a.join(b, "lang").where(F.col("source_a") != F.col("source_b"))
    p, q, p0, q0 = (F.col(c) for c in ("p_a", "p_b", "p0_a", "p0_b"))

    # Terms of both: what the two histograms and the count of the rest get wrong about them. One
    # row per unordered pair and term, with the values of both directions.
    x = scored.select("lang", "term", F.col("source").alias("source_a"), F.col("p").alias("p_a"), F.col("p0").alias("p0_a"))
    y = scored.select("lang", "term", F.col("source").alias("source_b"), F.col("p").alias("p_b"), F.col("p0").alias("p0_b"))
    there = gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
    back = gap(q, p) - gap(q, p0) - gap(q0, p) + gap(q0, p0)
    shared = (
        x.join(y, ["lang", "term"]).where(F.col("source_a") < F.col("source_b"))
        .groupBy("lang", "source_a", "source_b").agg(F.sum(there).alias("there"), F.sum(back).alias("back"))
    )
    both = shared.select("lang", "source_a", "source_b", F.col("there").alias("shared")).unionByName(
        shared.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), F.col("back").alias("shared"))
    )
    # Terms of one: sums over its histogram of counts, against the other's share of an absent term.
    histogram = materialise(scored.sparkSession, scored.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "term-histogram")
    of_a = histogram.select("lang", F.col("source").alias("source_a"), F.col("p").alias("p_a"), "terms")
    of_b = histogram.select("lang", F.col("source").alias("source_b"), F.col("p").alias("p_b"), "terms")
    key = ["lang", "source_a", "source_b"]
    ends = pairs.select(*key, "p0_a", "p0_b")
    only_a = ends.join(of_a, ["lang", "source_a"]).groupBy(*key).agg(F.sum(F.col("terms") * gap(p, q0)).alias("only_a"))
    only_b = ends.join(of_b, ["lang", "source_b"]).groupBy(*key).agg(F.sum(F.col("terms") * gap(p0, q)).alias("only_b"))
    rest = (F.col("v") - F.col("kinds_a") - F.col("kinds_b")) * gap(p0, q0)
    total = sum((F.coalesce(c, F.lit(0)) for c in (F.col("only_a"), F.col("only_b"), F.col("shared"), rest)), F.lit(0))
    return pairs.join(both, key, "left").join(only_a, key, "left").join(only_b, key, "left").select(
        "lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), total.cast("bigint").alias("value")
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language of ``documents``; see ``divergence``."""
    return divergence(read(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), uses AS (
    SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM uses GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}
), found AS (
    SELECT lang, source, term, count(*) AS n FROM uses JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (
    SELECT g.lang, g.source, coalesce(sum(f.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN found f USING (lang, source) GROUP BY ALL
), dense AS (
    SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
        1 + {UNIT}::HUGEINT * (coalesce(f.n, 0) + 1) // (g.total + s.v) AS p,
        1 + {UNIT}::HUGEINT * (k.n + 1) // (s.total + s.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN found f USING (lang, source, term)
), valued AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
    UNION ALL
    SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b USING (lang)
    WHERE a.source <> b.source AND a.lang NOT IN (SELECT lang FROM sizes)
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM valued
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""
