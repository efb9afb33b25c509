"""Forecasts, anomaly detection and explanation over indicator series.

Model: least-squares line on a time index with a band of 1.96 residual standard
errors, in closed form, so every series is fitted by the same aggregate.
``with_model`` is the hook for a custom per-series model.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import periods
from tidemark.functions.numeric import fixed, plain, rnd
from tidemark.operators import keyed
from tidemark.session import materialise

SERIES = ["indicator_code", "country_code"]
_STEPS = {"ANNUAL": 12, "QUARTERLY": 3, "MONTHLY": 1}
_BASE_YEAR = 1990


def time_index(day: Column, frequency: str) -> Column:
    """Number of whole steps since a fixed base year."""
    months = (F.year(day) - _BASE_YEAR) * 12 + F.month(day) - 1
    return F.floor(months / _STEPS[frequency]).cast("double")


def _residual_error(n: Column, slope: Column, sxy: Column, syy: Column) -> Column:
    return F.sqrt(F.greatest(syy - slope * sxy, F.lit(0.0)) / (n - 2))


def forecast(rows: DataFrame, horizon: int = 4, frequency: str = "QUARTERLY",
             min_points: int = K.FORECAST_MIN_POINTS) -> DataFrame:
    """Next ``horizon`` periods of every series with enough actuals."""
    day = periods.start_date(F.col("period"))
    x, y = F.col("_x"), F.col("value")
    fitted = (
        rows.withColumn("_day", day).withColumn("_x", time_index(F.col("_day"), frequency))
        .groupBy(*SERIES).agg(
            F.count(F.lit(1)).alias("n"), F.max("_day").alias("_last"), F.max("_x").alias("_x0"),
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.regr_sxy(y, x).alias("_sxy"), F.regr_syy(y, x).alias("_syy"),
        )
        .filter((F.col("n") >= min_points) & F.col("slope").isNotNull())
        .withColumn("_s", _residual_error(F.col("n"), F.col("slope"), F.col("_sxy"), F.col("_syy")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    )
    mid = F.col("intercept") + F.col("slope") * (F.col("_x0") + F.col("step"))
    half = F.lit(K.BAND_Z) * F.col("_s")
    ahead = F.add_months(F.col("_last"), F.col("step") * _STEPS[frequency])
    return fitted.select(
        *SERIES, periods.label(ahead, frequency).alias("period"), mid.alias("value"),
        (mid - half).alias("lower"), (mid + half).alias("upper"),
        F.lit(True).alias("is_forecast"), F.lit(K.FORECAST_DQ).alias("dq_score"),
    )


def best_per_period(gold: DataFrame, as_of: Column) -> DataFrame:
    """Highest-quality actual per period, periods ending after ``as_of`` dropped."""
    today = as_of.cast("date").cast("string")
    rows = gold.filter(~F.col("is_forecast") & (periods.end_key(F.col("period")) <= today))
    return keyed.latest(
        rows, [*SERIES, "period"], [F.coalesce(F.col("dq_score"), F.lit(0.0)), -F.col("record_id")],
        ["record_id", "value", "dq_score"],
    )


def fences(points: DataFrame) -> DataFrame:
    """Quartiles and the outlier fence of each series (one row per period, so exact is cheap)."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    stats = points.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), q.alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return stats.select(
        *SERIES, "n", q1.alias("q1"), q3.alias("q3"),
        (q1 - K.IQR_FENCE * (q3 - q1)).alias("fence_low"), (q3 + K.IQR_FENCE * (q3 - q1)).alias("fence_high"),
    )


def split_windows(points: DataFrame) -> DataFrame:
    """Outliers stripped, then the last points marked TEST and up to 20 before them TRAIN.

    All windows share one partitioning by series, so the plan has one shuffle.
    """
    series = Window.partitionBy(*SERIES)
    c = F.col
    fenced = points.withColumns({
        "_n": F.count(F.lit(1)).over(series),
        "_q": F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(series),
    }).withColumn("_iqr", c("_q")[1] - c("_q")[0])
    inside = (c("_iqr") <= 0) | c("value").between(
        c("_q")[0] - K.IQR_FENCE * c("_iqr"), c("_q")[1] + K.IQR_FENCE * c("_iqr")
    )
    clean = fenced.filter((c("_n") >= K.ANOMALY_MIN_POINTS) & inside)
    clean = clean.withColumn("_m", F.count(F.lit(1)).over(series)).filter(
        (c("_n") - c("_m") <= K.MAX_OUTLIER_SHARE * c("_n")) & (c("_m") >= K.ANOMALY_MIN_POINTS)
    )
    ordered = clean.withColumn("pos", F.row_number().over(series.orderBy("period")))
    from_end = c("_m") - c("pos")
    role = F.when(from_end < K.TEST_POINTS, "TEST").when(
        from_end < K.TEST_POINTS + K.TRAIN_POINTS, "TRAIN"
    )
    return ordered.withColumn("role", role).filter(c("role").isNotNull()).select(
        *SERIES, "period", "value", "pos", "role"
    )


def anomalies(windows: DataFrame) -> DataFrame:
    """Test points outside the band fitted on the train points."""
    series = Window.partitionBy(*SERIES)
    x = F.when(F.col("role") == "TRAIN", F.col("pos").cast("double"))
    y = F.when(F.col("role") == "TRAIN", F.col("value"))
    fitted = windows.withColumns({
        "_n": F.count(y).over(series),
        "_slope": F.regr_slope(y, x).over(series),
        "_intercept": F.regr_intercept(y, x).over(series),
        "_sxy": F.regr_sxy(y, x).over(series),
        "_syy": F.regr_syy(y, x).over(series),
    }).filter((F.col("role") == "TEST") & (F.col("_n") >= K.MIN_TRAIN_POINTS))
    scored = fitted.withColumns({
        "expected": F.col("_intercept") + F.col("_slope") * F.col("pos"),
        "_half": F.lit(K.BAND_Z) * _residual_error(F.col("_n"), F.col("_slope"), F.col("_sxy"), F.col("_syy")),
    })
    off = (F.col("value") - F.col("expected")) / F.col("_half")
    return scored.filter(F.abs(F.col("value") - F.col("expected")) > F.col("_half")).select(
        *SERIES, periods.start_date(F.col("period")).alias("date"), F.col("value").alias("actual"), "expected",
        (F.col("expected") - F.col("_half")).alias("lower"), (F.col("expected") + F.col("_half")).alias("upper"),
        F.when(F.col("_half") > 0, rnd(off, 2)).otherwise(F.lit(0.0)).alias("sigma"),
        deviation_pct("value", "expected", "_half").alias("deviation_pct"),
    )


def deviation_pct(actual: str, expected: str, half: str) -> Column:
    """Percent of the half band; without a band, percent of the expected size."""
    gap = F.col(actual) - F.col(expected)
    pct = (
        F.when(F.col(half) > 0, gap / F.col(half) * 100)
        .when(F.col(expected) != 0, gap / F.abs(F.col(expected)) * 100)
        .otherwise(F.lit(0.0))
    )
    return rnd(pct, 1)


def with_model(windows: DataFrame, model, schema: str) -> DataFrame:
    """Custom model per series: ``model(pandas frame of one series) -> pandas frame``.

    A series holds at most 25 points after ``split_windows``, so groups are small.
    """
    return windows.groupBy(*SERIES).applyInPandas(model, schema)


ROBUST_SCHEMA = "indicator_code string, country_code string, period string, actual double, expected double, lower double, upper double, outside boolean"


def robust_band(series: pd.DataFrame) -> pd.DataFrame:
    """Every test point against median +- ``ROBUST_WIDTH`` median absolute deviations of the train points.

    A model for ``with_model`` with ``ROBUST_SCHEMA``. Unlike the fitted line it isn't moved by
    one wild train point. Series with too few train points give no rows.
    """
    train = series.loc[series["role"] == "TRAIN", "value"].dropna()
    expected = train.median()
    half = K.ROBUST_WIDTH * (train - expected).abs().median()
    test = series[(series["role"] == "TEST") & (len(train) >= K.MIN_TRAIN_POINTS)]
    return test[[*SERIES, "period"]].assign(
        actual=test["value"], expected=expected, lower=expected - half, upper=expected + half, outside=(test["value"] - expected).abs() > half
    )


def ranked(found: DataFrame, limit: int | None = None, by: str = "deviation_pct") -> DataFrame:
    out = found.orderBy(F.abs(F.col(by)).desc(), *SERIES, "date")
    return out if limit is None else out.limit(limit)


def reference_years(found: DataFrame) -> DataFrame:
    """Per indicator the latest year all its countries share, else the latest best-covered year."""
    years = found.groupBy("indicator_code", F.year("date").alias("year")).agg(
        F.countDistinct("country_code").alias("covered")
    )
    totals = found.groupBy(F.col("indicator_code").alias("_i")).agg(F.countDistinct("country_code").alias("total"))
    joined = years.join(totals, F.col("indicator_code") == F.col("_i"))
    full = (F.col("covered") == F.col("total")).cast("int")
    return keyed.latest(joined, ["indicator_code"], [full, F.col("covered"), F.col("year")], ["year", "covered", "total"])


def linked_view(found: DataFrame) -> DataFrame:
    """Worst entry per pair inside the indicator's reference year."""
    ref = reference_years(found).select(F.col("indicator_code").alias("_i"), F.col("year").alias("_y"))
    inside = found.join(F.broadcast(ref), (F.col("indicator_code") == F.col("_i")) & (F.year("date") == F.col("_y")))
    worst = keyed.latest(
        inside, SERIES, [F.abs(F.col("sigma")), F.col("date")], ["date", "actual", "expected", "sigma", "deviation_pct"]
    )
    return worst


# --- Explanation ------------------------------------------------------------

def history_stats(gold: DataFrame, focus: DataFrame, n: int = 10) -> DataFrame:
    """Mean, sample deviation and range of the newest promoted values of other periods.

    ``focus``: one row per (indicator, country) with the period to leave out.
    """
    skip = focus.select(
        F.col("indicator_code").alias("_i"), F.col("country_code").alias("_c"), F.col("period").alias("_p")
    )
    others = gold.join(
        skip, (F.col("indicator_code") == F.col("_i")) & (F.col("country_code") == F.col("_c"))
        & (F.col("period") != F.col("_p"))
    ).filter(F.col("value").isNotNull())
    top = keyed.top_per_key(others, SERIES, [F.col("promoted_at").desc(), F.col("record_id").desc()], n)
    return top.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def explain_latest(gold: DataFrame) -> DataFrame:
    """Why the newest record of each (indicator, country) looks the way it does.

    ``gold`` carries revision_flag and revision_delta.
    """
    newest = materialise(gold.sparkSession, keyed.latest(
        gold, SERIES, [F.col("promoted_at"), F.col("record_id")],
        ["record_id", "period", "value", "standard_unit", "promoted_at", "revision_flag", "revision_delta"],
    ), "series-newest")
    stats = history_stats(gold, newest)
    c = F.col
    j = newest.join(stats.withColumnsRenamed({"indicator_code": "_si", "country_code": "_sc"}),
                    (c("indicator_code") == c("_si")) & (c("country_code") == c("_sc")), "left")
    j = j.withColumns({
        "_old": c("value") - c("revision_delta"),
        "_mean": F.coalesce(c("mean"), c("value")), "_low": F.coalesce(c("low"), c("value")),
        "_high": F.coalesce(c("high"), c("value")),
        "_z": F.when(c("std") > 0, F.abs(c("value") - c("mean")) / c("std")).otherwise(F.lit(0.0)),
    }).withColumns({
        "_pct": F.when(rnd("_old", 6) != 0, c("revision_delta") / c("_old") * 100).otherwise(F.lit(0.0)),
        "_z": rnd("_z", 6),
    }).withColumn("_pct", rnd("_pct", 4))
    revised = c("revision_flag") & c("revision_delta").isNotNull()
    size = F.abs(c("_pct"))

    def signed(x: str, digits: int) -> Column:
        return F.concat(F.when(rnd(x, digits) >= 0, F.lit("+")).otherwise(F.lit("")), fixed(x, digits))

    revision_text = F.concat(
        F.lit("This indicator was revised on "), c("promoted_at").cast("date").cast("string"),
        F.lit(". Original: "), plain("_old"), F.lit(". Revised: "), plain("value"),
        F.lit(". Change: "), signed("revision_delta", 3), F.lit(" ("), signed("_pct", 1), F.lit("%)."),
    )
    range_text = F.concat(
        F.lit("This value ("), plain("value"), F.lit(" "), c("standard_unit"), F.lit(") is "), fixed("_z", 1),
        F.lit(" standard deviations from the historical mean ("), fixed("_mean", 2), F.lit(" "), c("standard_unit"),
        F.lit("). Typical range: "), fixed("_low", 2), F.lit(" to "), fixed("_high", 2), F.lit("."),
    )
    severity = (
        F.when(revised & (size > 10), "HIGH").when(revised & (size > 5), "MEDIUM").when(revised, "LOW")
        .when(c("_z") > 3, "HIGH").when(c("_z") > 2, "MEDIUM").otherwise("LOW")
    )
    return j.select(
        *SERIES, "record_id", F.when(revised, "REVISION").otherwise("OUT_OF_RANGE").alias("anomaly_type"),
        F.when(revised, revision_text).otherwise(range_text).alias("explanation"), severity.alias("severity"),
    )


def explain_conflicts(pairs: DataFrame) -> DataFrame:
    """Two competing source values in words; the spread is relative to their mean.

    ``pairs``: source_a, value_a, reliability_a, source_b, value_b.
    """
    mean = (F.col("value_a") + F.col("value_b")) / 2
    spread = rnd(F.when(mean != 0, F.abs(F.col("value_a") - F.col("value_b")) / mean * 100).otherwise(F.lit(0.0)), 6)
    return pairs.withColumn("variance_pct", spread).withColumns({
        "explanation": F.concat(
            F.lit("Source '"), F.col("source_a"), F.lit("' reports "), plain("value_a"), F.lit("; Source '"),
            F.col("source_b"), F.lit("' reports "), plain("value_b"), F.lit(". Variance: "), fixed("variance_pct", 1),
            F.lit("%. Using '"), F.col("source_a"), F.lit("' (reliability score: "), fixed("reliability_a", 0), F.lit("/100)."),
        ),
        "severity": F.when(F.col("variance_pct") > 5, "HIGH").when(F.col("variance_pct") > 1, "MEDIUM").otherwise("LOW"),
    })
