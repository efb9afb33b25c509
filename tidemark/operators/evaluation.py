"""Answer keys from published data, and scoring of answers and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import text
from tidemark.functions.numeric import lookup, rnd
from tidemark.operators import keyed
from tidemark.session import materialise

_NAMES = {code: meta[0] for code, meta in K.INDICATORS.items()}


def _draw(seed: int, *parts: Column | str) -> Column:
    """Reproducible stand-in for a seeded shuffle."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *cols, F.lit(str(seed))))


def _indicator(c: str = "indicator_code") -> Column:
    return F.coalesce(lookup(F.col(c), _NAMES), F.col(c))


def _country(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(lookup(c, K.COUNTRY_PHRASES), c)


def _ids(*cols: str) -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in cols])


_ITEM = ["question_type", "_order", "question", "answer_kind", "expected_value", "expected_answer",
         "indicator_code", "period", "expected_source", "record_ids"]


def point_lookups(auth: DataFrame, seed: int, target: int) -> DataFrame:
    """Same number of single-value questions per indicator."""
    top = keyed.top_per_key(
        auth.withColumn("_d", _draw(seed, "indicator_code", "country_code", "period")),
        ["indicator_code"], [F.col("_d")], target,
    )
    n_indicators = auth.agg(F.countDistinct("indicator_code")).scalar()
    share = F.greatest(F.lit(1), F.floor(F.lit(target) / F.greatest(F.lit(1), n_indicators)))
    return top.filter(F.col("rank") <= share).orderBy("indicator_code", "_d").limit(target).select(
        F.lit("point_lookup").alias("question_type"),
        F.concat("indicator_code", F.lit("|"), "_d").alias("_order"),
        F.concat(F.lit("What was the "), _indicator(), F.lit(" of "), _country("country_code"), F.lit(" in "),
                 "period", F.lit("?")).alias("question"),
        F.lit("numeric").alias("answer_kind"), F.col("value").alias("expected_value"),
        text.value_phrase(F.col("value"), F.col("standard_unit")).alias("expected_answer"),
        "indicator_code", "period", F.col("source_code").alias("expected_source"), _ids("record_id").alias("record_ids"),
    )


def comparisons(auth: DataFrame, seed: int, target: int) -> DataFrame:
    """Two drawn countries of an (indicator, period) with different values."""
    drawn = auth.withColumn("_d", _draw(seed, "indicator_code", "period", "country_code"))
    two = keyed.top_per_key(drawn, ["indicator_code", "period"], [F.col("_d")], 2)
    side = F.struct("country_code", "value", "record_id", "source_code")
    pair = two.groupBy("indicator_code", "period").agg(
        F.max(F.when(F.col("rank") == 1, side)).alias("a"), F.max(F.when(F.col("rank") == 2, side)).alias("b")
    ).filter(F.col("b").isNotNull() & (F.col("a.value") != F.col("b.value")))
    winner = F.when(F.col("a.value") > F.col("b.value"), F.col("a.country_code")).otherwise(F.col("b.country_code"))
    return pair.withColumn("_order", _draw(seed, "indicator_code", "period")).orderBy("_order").limit(target).select(
        F.lit("comparison").alias("question_type"), "_order",
        F.concat(F.lit("Which had a higher "), _indicator(), F.lit(" in "), "period", F.lit(", "),
                 _country(F.col("a.country_code")), F.lit(" or "), _country(F.col("b.country_code")), F.lit("?")).alias("question"),
        F.lit("categorical").alias("answer_kind"), F.lit(None).cast("double").alias("expected_value"),
        _country(winner).alias("expected_answer"), "indicator_code", "period",
        F.col("a.source_code").alias("expected_source"), _ids("a.record_id", "b.record_id").alias("record_ids"),
    )


def superlatives(auth: DataFrame, seed: int, target: int, highest: bool) -> DataFrame:
    """Country with the extreme value among at least three."""
    kind, word = ("superlative_high", "highest") if highest else ("superlative_low", "lowest")
    side = F.struct("country_code", "record_id", "source_code")
    size = -F.col("value") if highest else F.col("value")
    best = auth.groupBy("indicator_code", "period").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(side, F.struct(size, F.col("country_code"))).alias("x")
    ).filter(F.col("n") >= 3)
    return best.withColumn("_order", _draw(seed, F.lit(kind), "indicator_code", "period")).orderBy("_order").limit(target).select(
        F.lit(kind).alias("question_type"), "_order",
        F.concat(F.lit(f"Among the tracked countries, which had the {word} "), _indicator(), F.lit(" in "), "period",
                 F.lit("?")).alias("question"),
        F.lit("categorical").alias("answer_kind"), F.lit(None).cast("double").alias("expected_value"),
        _country("x.country_code").alias("expected_answer"), "indicator_code", "period",
        F.col("x.source_code").alias("expected_source"), _ids("x.record_id").alias("record_ids"),
    )


def trends(auth: DataFrame, seed: int, target: int, gap: int) -> DataFrame:
    """First pair of years ``gap`` apart, else first and last year; direction of the change."""
    key = ["indicator_code", "country_code"]
    point = auth.select(*key, F.col("period").cast("int").alias("year"), "value", "record_id", "source_code")
    side = F.struct("year", "value", "record_id", "source_code")
    ends = point.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(side, "year").alias("first"), F.max_by(side, "year").alias("last")
    )
    later = point.select(*key, (F.col("year") - gap).alias("year"), side.alias("b"))
    spaced = point.join(later, [*key, "year"]).groupBy(*key).agg(
        F.min_by(F.struct(side.alias("a"), F.col("b").alias("b")), "year").alias("s")
    )
    pair = ends.join(spaced, key, "left").select(
        *key, "n", F.coalesce("s.a", "first").alias("a"), F.coalesce("s.b", "last").alias("b")
    ).filter((F.col("n") >= 2) & (F.col("a.value") != F.col("b.value")))
    years = [F.col(f"{x}.year").cast("string") for x in ("a", "b")]
    return pair.withColumn("_order", _draw(seed, F.lit("trend"), *key)).orderBy("_order").limit(target).select(
        F.lit("trend").alias("question_type"), "_order",
        F.concat(F.lit("Did the "), _indicator(), F.lit(" of "), _country("country_code"),
                 F.lit(" increase or decrease between "), years[0], F.lit(" and "), years[1], F.lit("?")).alias("question"),
        F.lit("direction").alias("answer_kind"), F.lit(None).cast("double").alias("expected_value"),
        F.when(F.col("b.value") > F.col("a.value"), "increased").otherwise("decreased").alias("expected_answer"),
        "indicator_code", F.concat(years[0], F.lit("/"), years[1]).alias("period"),
        F.col("b.source_code").alias("expected_source"), _ids("a.record_id", "b.record_id").alias("record_ids"),
    )


def ground_truth(auth: DataFrame, seed: int = 42, targets: dict | None = None, gap: int = K.TREND_GAP_YEARS) -> DataFrame:
    """Numbered answer key; at most the sum of the targets, so the numbering window is small.

    The authoritative records (one per key) feed six selections, so they are written
    once instead of being derived from the published table six times.
    """
    t = targets or K.QUESTION_TARGETS
    auth = materialise(auth.sparkSession, auth, "authoritative")
    kinds = [
        point_lookups(auth, seed, t["point_lookup"]), comparisons(auth, seed, t["comparison"]),
        superlatives(auth, seed, t["superlative_high"], True), superlatives(auth, seed, t["superlative_low"], False),
        trends(auth, seed, t["trend"], gap),
    ]
    items = None
    for i, kind in enumerate(kinds):
        part = kind.select(*_ITEM).withColumn("_kind", F.lit(i))
        items = part if items is None else items.unionByName(part)
    number = F.row_number().over(Window.orderBy("_kind", "_order"))
    return items.select(
        F.concat(F.lit("gt-"), F.lpad(number.cast("string"), 5, "0")).alias("id"),
        *[c for c in _ITEM if c != "_order"],
    )


def score_answers(entries: DataFrame) -> DataFrame:
    """Correctness and source citation of each response.

    ``entries``: id, question_type, answer_kind, expected_value, expected_answer,
    expected_source, response, cited_sources.
    """
    c = F.col
    numeric = c("answer_kind") == "numeric"
    value_ok = text.numeric_match(c("expected_value"), text.grouped_numbers(c("response")))
    named = text.contains_ci(c("response"), c("expected_answer"))
    cited = text.contains_ci(c("cited_sources"), c("expected_source")) | text.contains_ci(c("response"), c("expected_source"))
    return entries.select(
        "id", "question_type", F.coalesce(F.when(numeric, value_ok).otherwise(named), F.lit(False)).alias("correct"),
        F.when(numeric, value_ok).alias("value_correct"), cited.alias("source_cited"),
    )


def answer_rollup(scored: DataFrame) -> DataFrame:
    """Accuracy per question type and overall (type ALL)."""
    n = F.count(F.lit(1))
    return scored.rollup("question_type").agg(
        F.grouping("question_type").alias("_all"), n.alias("total"), F.count_if("correct").alias("correct"),
        rnd(F.count_if("correct") / n, 4).alias("accuracy"), rnd(F.count_if("source_cited") / n, 4).alias("source_cited_rate"),
    ).select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("question_type")).alias("question_type"),
        "total", "correct", "accuracy", "source_cited_rate",
    )


def retrieval_scores(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """hit@k and recall@k per question. ``hits``: query_id, vec_id, rank (at most k per question)."""
    lists = hits.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias("retrieved")
    )
    return questions.join(lists, "query_id", "left").select(
        "query_id", "question_type",
        text.hit_at_k(F.col("expected_ids"), F.coalesce("retrieved", F.array().cast("array<bigint>")), k).alias("hit"),
        text.recall_at_k(F.col("expected_ids"), F.coalesce("retrieved", F.array().cast("array<bigint>")), k).alias("recall"),
    )


def retrieval_rollup(scored: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return scored.rollup("question_type").agg(
        F.grouping("question_type").alias("_all"), n.alias("total"),
        rnd(F.count_if("hit") / n, 4).alias("hit_rate"), rnd(F.avg("recall"), 4).alias("mean_recall"),
    ).select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("question_type")).alias("question_type"),
        "total", "hit_rate", "mean_recall",
    )
