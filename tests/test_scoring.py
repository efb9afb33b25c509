"""Parsing, scoring and validation facts on tiny frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing, periods, scoring, text
from tidemark.operators import medallion as M
from tidemark.sources.views import clock

def NOW():
    return clock("2024-02-01 00:00:00")


def one(spark, expr, **cols):
    names, values = zip(*cols.items()) if cols else (("x",), (1,))
    schema = ", ".join(
        f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values)
    )
    return spark.createDataFrame([values], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw, unit, want", [
    ("2.5", "PCT", 2.5), ("1.5T", "USD_BN", 1500.0), ("500B", "USD_BN", 500.0), ("250000M", "USD_BN", 250.0),
    ("N/A", "PCT", None), ("", "PCT", None), ("$1.23 trillion", "USD_BN", 1230.0), ("15048964444000", "USD_BN", 15048.964444),
    ("331000000", "MILLIONS", 331.0), ("2.5 percent", "PCT", 2500.0), ("331 million", "MILLIONS", 0.331), ("-1,234.5", "PCT", -1234.5),
])
def test_parse_value(spark, raw, unit, want):
    got = one(spark, parsing.parse_value("raw", "unit"), raw=raw, unit=unit)
    assert got == pytest.approx(want) if want is not None else got is None


def test_strict_suffix_reads_percent_as_is(spark):
    assert one(spark, parsing.parse_value("raw", "unit", strict_suffix=True), raw="2.5 percent", unit="PCT") == 2.5


@pytest.mark.parametrize("raw, want", [
    ("GDP forecast for 2025", True), ("projected to grow", True), ("estimate: 3.2%", True), ("GDP grew 2.1% in 2023", False),
])
def test_forecast_words(spark, raw, want):
    assert one(spark, parsing.is_forecast("raw"), raw=raw) is want


BRONZE = ("record_id bigint, indicator_code string, country_code string, period string, raw_value string, raw_unit string, "
          "standard_unit string, source_code string, source_url string, crawled_at timestamp_ntz, tenant_id bigint")


def silver(spark, **change):
    row = dict(record_id=1, indicator_code="GDP_GROWTH", country_code="USA", period="2023", raw_value="2.5", raw_unit="percent",
               standard_unit="PCT", source_code="FRED", source_url="u", crawled_at=dt.datetime(2024, 1, 30), tenant_id=None)
    row.update(change)
    df = spark.createDataFrame([tuple(row.values())], BRONZE)
    return M.to_silver(df, NOW()).first()


def test_clean_row_scores_100(spark):
    s = silver(spark)
    assert s.dq_score == 100.0 and s.failure_reasons == [] and s.dq_status == "AUTO_PROMOTED"
    assert s.normalisation == "unit_converted:percent->PCT"


def test_out_of_bounds_is_rejected(spark):
    s = silver(spark, raw_value="200")
    assert (s.dq_score, s.dq_status) == (68.0, "REJECTED")
    assert s.failure_reasons == ["value_200.0_above_max_30.0"]


def test_stale_year_is_exactly_ninety(spark):
    s = silver(spark, period="2015")
    assert (s.dq_score, s.dq_status, s.timeliness) == (90.0, "AUTO_PROMOTED", 50.0)
    assert one(spark, scoring.oversight_decision(F.col("x")), x=90.0) == "PENDING_REVIEW"


def test_empty_row_is_rejected(spark):
    s = silver(spark, indicator_code=None, country_code=None, period=None, raw_value=None, standard_unit=None, raw_unit=None)
    assert s.dq_score < 70
    assert {"value_not_parseable", "missing_period", "period_format_unrecognized", "missing_standard_unit"} <= set(s.failure_reasons)


def test_unit_clash(spark):
    s = silver(spark, raw_unit="USD billions")
    assert s.consistency == 60.0 and s.failure_reasons == ["unit_mismatch_raw=USD billions_expected_PCT"]


def test_raw_record_errors(spark):
    errors = parsing.record_errors(*[F.col(c) for c in "cpiv"])
    bad = spark.createDataFrame([("US", "latest", "BOGUS", None)], "c string, p string, i string, v string").select(errors.alias("e")).first().e
    good = spark.createDataFrame([("USA", "2024-Q2", "GDP_GROWTH", "1")], "c string, p string, i string, v string").select(errors.alias("e")).first().e
    assert len(bad) == 4 and good == []


@pytest.mark.parametrize("period, start, end", [
    ("2023", "2023-01-01", "2023-12-31"), ("2023-Q3", "2023-07-01", "2023-09-28"),
    ("2023-05", "2023-05-01", "2023-05"), ("2023-05-09", "2023-05-09", "2023-05-09"),
])
def test_periods(spark, period, start, end):
    assert str(one(spark, periods.start_date(F.col("p")), p=period)) == start
    assert one(spark, periods.end_key(F.col("p")), p=period) == end


@pytest.mark.parametrize("conf, want", [(0.85, "AUTO_ACCEPT"), (0.84, "QUEUE_REVIEW"), (0.70, "QUEUE_REVIEW"), (0.69, "REJECT")])
def test_confidence_gate(spark, conf, want):
    assert one(spark, scoring.confidence_decision(F.col("x")), x=conf) == want


@pytest.mark.parametrize("code, want", [
    ("GDP_GROWTH", "TIER1"), ("CPI_INFLATION_CORE", "TIER1"), ("EXPORTS_PCT_GDP", "TIER2"), ("SOMETHING", "TIER3"),
])
def test_tiers(spark, code, want):
    assert one(spark, scoring.sla_tier(F.col("x")), x=code) == want


def test_numbers_and_matches(spark):
    assert one(spark, text.grouped_numbers(F.col("t")), t="from 1,234.5 to -7 in 2023") == [1234.5, -7.0, 2023.0]
    assert one(spark, text.numeric_match(F.lit(2.1), text.grouped_numbers(F.col("t"))), t="about 2.15%") is True
    assert one(spark, text.numeric_match(F.lit(100.0), text.grouped_numbers(F.col("t"))), t="about 103") is False
    assert one(spark, text.recall_at_k(F.array(F.lit("a"), F.lit("b")), F.array(*map(F.lit, "xayz")), 4)) == 0.5


def test_redaction(spark):
    got = one(spark, text.redact(F.col("t")), t="mail a.b@c.org or call 555-123-4567, host 10.1.2.3, id 123-45-6789")
    assert got == "mail [REDACTED_EMAIL] or call [REDACTED_PHONE], host [REDACTED_IP_ADDRESS], id [REDACTED_NATIONAL_ID]"
    assert one(spark, text.redact(F.col("t")), t="What is GDP?") == "What is GDP?"


def test_value_phrase(spark):
    assert one(spark, text.value_phrase(F.lit(1234.5), F.col("u")), u="USD_BN") == "1,234.5 billion USD"
    assert one(spark, text.value_phrase(F.lit(2.0), F.col("u")), u="PCT") == "2%"


def test_reason_sentences(spark):
    s = one(spark, text.reason_sentence(F.col("r")), r="value_200.0_above_max_30.0")
    assert s == "Value 200.0 exceeds the maximum plausible bound (30.0)."
    assert one(spark, text.reason_sentence(F.col("r")), r="odd_new_code") == "Odd new code"
    assert one(spark, text.reason_dimension(F.col("r")), r="unit_mismatch_raw=x_expected_PCT") == "consistency"


def test_inline_citations(spark):
    got = one(spark, text.inline_citations(F.col("t")), t="Up 2% [Source: World Bank, 2023] and [source: IMF , 2024].")
    assert [(c.source_name, c.period) for c in got] == [("World Bank", "2023"), ("IMF", "2024")]
