"""Operator semantics on small frames, several against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators import evaluation as EV
from tidemark.operators import governance as G
from tidemark.operators import keyed
from tidemark.operators import limits
from tidemark.operators import medallion as M
from tidemark.operators import provenance as PV
from tidemark.operators import reconcile as R
from tidemark.operators import responses as RS
from tidemark.operators import search as S
from tidemark.operators import trend as T
from tidemark.operators import upkeep as U
from tidemark.sources import landed as L
from tidemark.sources import sinks
from tidemark.sources.views import clock

def NOW():
    return clock("2024-02-01 00:00:00")
DAY = dt.datetime(2024, 1, 1)

CAND = "indicator_code string, country_code string, period string, source_code string, value double, reliability double, crawled_at timestamp_ntz"
GOLD = "record_id bigint, indicator_code string, country_code string, period string, value double, source_code string, promoted_at timestamp_ntz"


def resolve(spark, *sources, gold=()):
    rows = [("GDP_GROWTH", "USA", "2023", s, v, r, DAY) for s, v, r in sources]
    published = [(i, "GDP_GROWTH", "USA", p, v, s, DAY) for i, (p, v, s) in enumerate(gold)]
    return R.resolve_conflicts(spark.createDataFrame(rows, CAND), spark.createDataFrame(published, GOLD), NOW()).first()


def test_small_spread_is_routine(spark):
    got = resolve(spark, ("WB", 2.50, 90.0), ("IMF", 2.51, 85.0))
    assert (got.severity, got.selected_source, got.requires_review) == ("ROUTINE", "WB", False)


def test_large_spread_keeps_published_value(spark):
    got = resolve(spark, ("WB", 2.0, 90.0), ("IMF", 3.5, 85.0), gold=[("2021", 1.9, "OECD"), ("2022", 2.2, "FRED")])
    assert (got.severity, got.selected_source, got.selected_value, got.requires_review) == ("MAJOR", "FRED", 2.2, True)
    assert resolve(spark, ("WB", 2.0, 90.0), ("IMF", 3.5, 85.0)).selected_source == "WB"


def test_medium_spread_blends_and_single_source_has_no_conflict(spark):
    assert resolve(spark, ("WB", 100.0, 90.0), ("IMF", 103.0, 85.0)).severity == "MODERATE"
    got = resolve(spark, ("WB", 7.0, 10.0))
    assert (got.severity, got.variance_pct, got.selected_value) == ("ROUTINE", 0.0, 7.0)


def test_revision_significance(spark):
    gold = spark.createDataFrame([(1, "G", "USA", "2023", 2.0, "WB", DAY), (2, "C", "USA", "2023", 2.5, "WB", DAY)], GOLD)
    new = spark.createDataFrame([("G", "USA", "2023", "WB", 3.0), ("C", "USA", "2023", "WB", 2.5)],
                                "indicator_code string, country_code string, period string, source_code string, value double")
    rows = R.detect_revisions(gold, new.withColumn("revised_at", NOW())).collect()
    assert len(rows) == 1 and rows[0].is_significant and rows[0].revision_pct == 50.0


def test_time_travel(spark):
    rows = [(i, "G", "USA", "2023", float(v), "WB", dt.datetime(2024, m, 1)) for i, (v, m) in enumerate([(1, 1), (2, 3), (3, 6)])]
    gold = spark.createDataFrame(rows, GOLD)
    log = R.revision_chain(gold)
    for month, want in ((2, 1.0), (4, 2.0), (7, 3.0)):
        got = R.value_as_of(gold, log, clock(f"2024-0{month}-01 00:00:00")).first()
        assert got.value == want


@pytest.mark.parametrize("bucket", ["HOUR", "DAY", "MONTH"])
@pytest.mark.parametrize("forward", [True, False])
def test_carry_equals_brute_force(spark, bucket, forward):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), DAY + dt.timedelta(minutes=rng.randrange(6000)), rng.choice([None, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, k string, at timestamp_ntz, v double")
    got = {r.id: r.o for r in keyed.carry(df, ["k"], "at", "id", F.col("v"), "o", bucket, forward).collect()}
    ordered = sorted(rows, key=lambda r: (r[2], r[0]), reverse=not forward)
    last = {}
    for i, k, _, v in ordered:
        assert got[i] == last.get(k)
        if v is not None:
            last[k] = v


@pytest.mark.parametrize("forward", [True, False])
def test_carry_of_several_values_equals_brute_force(spark, forward):
    rng = random.Random(2)
    rows = [
        (i, rng.choice(["a", "a", "b", None]), rng.choice([1, 2, None]), DAY + dt.timedelta(minutes=rng.randrange(6000)), rng.choice([None, rng.random()]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id bigint, k string, t bigint, at timestamp_ntz, v double")
    values = {"own": (F.col("v"), ["t"]), "whole": (F.col("v") * 2, []), "few": (F.when(F.col("t") == 1, F.col("v")), [])}
    got = {r.id: (r.own, r.whole, r.few) for r in keyed.carry_several(df, ["k"], "at", "id", values, "DAY", forward).collect()}
    own, whole, few = {}, {}, {}
    for i, k, t, _, v in sorted(rows, key=lambda r: (r[3], r[0]), reverse=not forward):
        assert got[i] == (own.get((k, t)), whole.get(k), few.get(k))
        if v is not None:
            own[k, t], whole[k] = v, 2 * v
            if t == 1:
                few[k] = v


def test_carry_shuffles_its_rows_once(spark):
    df = spark.createDataFrame([(1, "a", 1, DAY, 1.0)], "id bigint, k string, t bigint, at timestamp_ntz, v double")
    values = {"own": (F.col("v"), ["t"]), "whole": (F.col("v"), [])}
    plan = keyed.carry_several(df, ["k"], "at", "id", values)._jdf.queryExecution().executedPlan().toString()
    # One exchange of all rows; the others belong to the summaries (partial aggregate, then their window).
    assert plan.count("Exchange hashpartitioning(_place#") <= 1 + len(values) and "Join" not in plan


def test_republishing_flags_a_revision_with_delta(spark):
    rows = [(1, "G", "U", "23", 2.0, False, DAY), (2, "G", "U", "23", 9.0, True, DAY + dt.timedelta(1)),
            (3, "G", "U", "23", 2.0, False, DAY + dt.timedelta(2)), (4, "G", "U", "24", 1.0, False, DAY)]
    df = spark.createDataFrame(rows, "record_id bigint, indicator_code string, country_code string, period string, value double, is_forecast boolean, promoted_at timestamp_ntz")
    got = {r.record_id: (r.revision_flag, r.revision_delta) for r in M.flag_revisions(df).collect()}
    assert got == {1: (False, None), 2: (True, 7.0), 3: (True, 0.0), 4: (False, None)}


def brute_limits(rows):
    state, out = {}, {}
    for hit, ident, role, t in sorted(rows, key=lambda x: (x[1], x[3], x[0])):
        daily, burst = K.RATE_LIMITS.get(role, K.RATE_LIMITS["PUBLIC"])
        s = state.setdefault(ident, [t.date(), 0, t, 0])
        if s[0] != t.date():
            s[0], s[1] = t.date(), 0
        if t - s[2] >= dt.timedelta(minutes=1):
            s[2], s[3] = t, 0
        ok = s[1] < daily and s[3] < burst
        midnight = dt.datetime.combine(t.date() + dt.timedelta(days=1), dt.time())
        wait = None if ok else int((midnight - t).total_seconds()) if s[1] >= daily else max(1, int((s[2] + dt.timedelta(minutes=1) - t).total_seconds()))
        s[1] += ok
        s[3] += ok
        out[hit] = (ok, max(0, daily - s[1]), max(0, burst - s[3]), wait)
    return out


def limit_rows(frame):
    return {r.hit_id: (r.allowed, r.daily_remaining, r.minute_remaining, r.retry_after) for r in frame.collect()}


def test_rate_limits_equal_brute_force(spark):
    rng, rows = random.Random(7), []
    for ident in range(5):
        t = dt.datetime(2024, 1, 31, 23, 20)
        for _ in range(200):
            t += dt.timedelta(seconds=rng.choice([0, 0, 1, 5, 20, 61]), microseconds=rng.randrange(10**6) if ident % 2 else 0)
            rows.append((len(rows), ident, ["PUBLIC", "EXTERNAL_BUSINESS", "ADMIN", "OTHER"][ident % 4], t))
    df = spark.createDataFrame(rows, "hit_id bigint, identifier bigint, role string, hit_at timestamp_ntz")
    assert limit_rows(limits.decide(df)) == brute_limits(rows)


def test_rate_limits_over_midnight_and_hours(spark):
    rng, rows = random.Random(8), []
    for ident, role in enumerate(["PUBLIC", "EXTERNAL_BUSINESS", "PUBLIC"]):
        for day in (0, 1, 3):
            for hour in (0, 23):
                start = dt.datetime(2024, 1, 1 + day, hour, 0 if hour == 0 else 59)
                rows += [(0, ident, role, start + dt.timedelta(seconds=rng.randrange(120))) for _ in range(rng.choice([1, 4, 40, 900]))]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "hit_id bigint, identifier bigint, role string, hit_at timestamp_ntz").repartition(3)
    assert limit_rows(limits.decide(df)) == brute_limits(rows)


def test_range_match_equals_brute_force(spark):
    rng = random.Random(3)
    values = [rng.uniform(0.005, 1300) ** rng.choice([0.3, 1]) for _ in range(60)] + [-5.0, 0.0]
    numbers = [rng.uniform(0.011, 999) for _ in range(300)]
    gold = spark.createDataFrame([(v,) for v in values], "value double")
    df = spark.createDataFrame(list(enumerate(numbers)), "id bigint, x double")
    got = {r.id: r.m for r in df.withColumn("b", RS.bucket_map(gold)).select("id", RS.near_any(F.col("x"), F.col("b")).alias("m")).collect()}
    assert got == {i: any(x * 0.9 <= v <= x * 1.1 for v in values) for i, x in enumerate(numbers)}


def test_grounding_equals_brute_force(spark):
    rng = random.Random(4)
    docs, vals = [], []
    for i in range(60):
        docs.append((i, " ".join(f"{rng.uniform(-40, 40):.2f}" for _ in range(rng.randrange(4)))))
        vals += [(i, rng.choice([rng.uniform(-40, 40), 0.0, 0.3])) for _ in range(rng.randrange(6))]
    got = {r.id: (r.n_unmatched, r.confidence) for r in RS.grounding(
        spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(vals, "id bigint, value double"), "id").collect()}
    for i, body in docs:
        known = [v for j, v in vals if j == i]
        nums = [float(t) for t in body.split()]
        miss = sum(not any(abs(n - g) <= max(0.05, 0.05 * abs(g)) for g in known) for n in nums)
        level = "low" if nums and not known else "high" if not nums or not miss else "low" if miss / len(nums) >= 0.5 else "medium"
        assert got[i] == (miss, level), (i, body, known)


def test_grounding_facts(spark):
    rows = spark.createDataFrame([(1, "GDP growth was 2.5% in 2023."), (2, "GDP growth reached 99.9% in 2023."), (3, "Indicators matter.")], "id bigint, text string")
    vals = spark.createDataFrame([(1, 2.5), (2, 2.5)], "id bigint, value double")
    got = {r.id: r.confidence for r in RS.grounding(rows, vals, "id").collect()}
    assert got == {1: "high", 2: "low", 3: "high"}


ADVICE = [
    ("Should I buy given inflation?", "Based on CPI data you should buy gold ETFs as a hedge."),
    ("Give me a portfolio for this GDP", "I suggest a portfolio of 60% equities."),
    ("What's the price target given low unemployment?", "The price target for tech stocks is $250."),
]
OFF_TOPIC = ["What's the best recipe for chocolate cake?", "Write me a poem about spring", "Tell me about quantum physics"]


def test_guardrails(spark):
    pairs = [(i, q, r) for i, (q, r) in enumerate(ADVICE)]
    pairs += [(10 + i, q, "Here is information about your question.") for i, q in enumerate(OFF_TOPIC)]
    pairs += [(20, "What is the GDP outlook?", "GDP is projected to grow 2%."), (21, "What is CPI?", "CPI rose 3%.")]
    got = {r.id: r for r in RS.guard(spark.createDataFrame(pairs, "id bigint, query string, response string")).collect()}
    assert all(got[i].triggered_filter == "InvestmentAdviceFilter" for i in range(3))
    assert all(got[10 + i].triggered_filter == "ScopeFilter" for i in range(3))
    assert got[20].passed and got[20].final_response.endswith(K.DISCLAIMER)
    assert got[21].passed and got[21].final_response == "CPI rose 3%."


def test_output_validation(spark):
    rows = spark.createDataFrame([
        (1, "GDP grew 2.5% last year according to the data [Source: World Bank, 2023]."), (2, "Short."),
        (3, "The value of 777 stands alone here without any support in published data (IMF)."),
    ], "id bigint, text string")
    gold = spark.createDataFrame([(2.4,), (2023.0,)], "value double")
    got = {r.id: r for r in RS.validate_output(rows, gold, "id").collect()}
    assert got[1].valid and got[1].confidence == pytest.approx(0.2)
    assert set(got[2].issues) == {"Response missing source citation", "Response too short (< 50 chars)"}
    assert got[3].confidence == 0.4 and not got[3].valid


def test_anomaly_and_forecast(spark):
    rows = [("G", "USA", str(1995 + i), 2.0 + 0.1 * i + (0.01 if i % 2 else 0.0)) for i in range(14)]
    rows[-1] = ("G", "USA", "2008", 9.0)
    df = spark.createDataFrame(rows, "indicator_code string, country_code string, period string, value double")
    found = T.anomalies(T.split_windows(df)).collect()
    assert len(found) == 1 and found[0].actual == 9.0 and found[0].sigma > 1 and found[0].deviation_pct > 100
    ahead = T.forecast(df.filter("period < '2008'"), 3, "ANNUAL").orderBy("period").collect()
    assert [r.period for r in ahead] == ["2008", "2009", "2010"]
    assert ahead[0].value == pytest.approx(3.3, abs=0.05) and ahead[0].lower < ahead[0].value < ahead[0].upper
    assert T.forecast(df.limit(4), 3, "ANNUAL").count() == 0
    half = spark.createDataFrame([(3.5, 2.0, 0.0)], "a double, e double, h double")
    assert half.select(T.deviation_pct("a", "e", "h").alias("d")).first().d == 75.0


def test_custom_model_hook(spark):
    df = spark.createDataFrame([("G", "USA", str(1990 + i), float(i)) for i in range(12)], "indicator_code string, country_code string, period string, value double")
    out = T.with_model(T.split_windows(df), lambda p: p.groupby(["indicator_code", "country_code"], as_index=False)["value"].mean(),
                       "indicator_code string, country_code string, value double")
    assert out.first().value == 5.5


def test_robust_band_ignores_a_wild_train_point(spark):
    values = [float(i % 3) for i in range(20)] + [1.0, 2.0, 9.0, -9.0, 0.0]
    values[7] = 14.0
    rows = [("G", "USA", str(1990 + i), v) for i, v in enumerate(values)]
    short = [("H", "USA", str(1990 + i), 1.0, i, "TRAIN" if i < 4 else "TEST") for i in range(5)]
    windows = T.split_windows(spark.createDataFrame(rows, "indicator_code string, country_code string, period string, value double"))
    few = spark.createDataFrame(short, "indicator_code string, country_code string, period string, value double, pos int, role string")
    found = T.with_model(windows.unionByName(few.withColumn("value", T.F.col("value") * T.F.col("pos"))), T.robust_band, T.ROBUST_SCHEMA)
    got = found.orderBy("period").collect()
    assert [(r.period, r.actual, r.outside) for r in got] == [
        ("2010", 1.0, False), ("2011", 2.0, False), ("2012", 9.0, True), ("2013", -9.0, True), ("2014", 0.0, False)]
    assert {(r.expected, r.lower, r.upper) for r in got} == {(1.0, -3.5, 5.5)}


def test_costs(spark):
    df = spark.createDataFrame([(1, "s", "LLM", "gemini", 1000), (2, "s", "STORAGE", None, 2**30), (3, "s", "CRAWLER", None, 60), (4, "t", "LLM", "unknown", 1000)],
                               "cost_id bigint, source_id string, category string, provider string, quantity bigint")
    got = {r.source_id: r for r in U.cost_report(U.priced(df)).collect()}
    assert got["s"].llm_usd == 0.00015 and got["s"].storage_usd == 0.023 and got["s"].crawler_usd == 0.00006
    assert got["t"].total_cost_usd == 0.001


def test_block_ladder(spark):
    rows = [(1, 1, DAY), (2, 2, DAY), (3, 2, DAY), (4, 3, DAY), (5, 3, DAY), (6, 3, DAY)]
    got = {r.source_url: r for r in U.block_state(spark.createDataFrame(rows, "block_id bigint, source_url bigint, blocked_at timestamp_ntz"), clock("2024-01-01 02:00:00")).collect()}
    assert not got[1].is_blocked and got[2].is_blocked and got[3].is_permanent and got[3].cooldown_until is None


def test_consent_and_policies(spark):
    ev = [(1, 1, "A", "grant", DAY), (2, 1, "A", "revoke", DAY + dt.timedelta(1)), (3, 2, "A", "revoke", DAY), (4, 2, "A", "grant", DAY)]
    got = {r.user_id_hash: r.is_active for r in U.consent_state(spark.createDataFrame(ev, "event_id bigint, user_id bigint, consent_type string, action string, noted_at timestamp_ntz")).collect()}
    assert sorted(got.values()) == [False, True]
    pol = spark.createDataFrame([("p", 1, DAY), ("p", 2, DAY + dt.timedelta(400))], "policy_name string, policy_id bigint, effective_date timestamp_ntz")
    v = {r.policy_id: r for r in U.policy_versions(pol).collect()}
    assert v[1].valid_to == DAY + dt.timedelta(400) and not v[1].is_active and v[2].is_active


def test_oversight_and_escalation(spark):
    ap = [(1, 10, 80.0, "PENDING_REVIEW", DAY), (1, 11, 80.0, "APPROVED", DAY + dt.timedelta(1)), (2, 12, 75.0, "PENDING_REVIEW", DAY),
          (3, 13, 75.0, "APPROVED", DAY), (3, 14, 75.0, "PENDING_REVIEW", DAY + dt.timedelta(1))]
    got = G.oversight_pending(spark.createDataFrame(ap, "silver_id bigint, approval_id bigint, dq_score double, decision string, decided_at timestamp_ntz"))
    assert {r.silver_id for r in got.collect()} == {2, 3}
    tasks = spark.createDataFrame([(1, "PENDING", 2, DAY), (2, "PENDING", 5, DAY), (3, "DONE", 2, DAY)], "task_id bigint, status string, level int, sla_deadline timestamp_ntz")
    moved = {r.task_id: r for r in G.escalate(tasks, NOW()).collect()}
    assert moved[1].level == 3 and moved[1].sla_deadline == dt.datetime(2024, 2, 1, 8)
    assert moved[2].stuck_at_top and moved[2].level == 5 and moved[3].escalated_from is None


def test_citations(spark):
    rows = [(0, "a", "gold", "WB", "G", "U", "23", None), (1, "a", "gold", "WB", "G", "U", "23", None), (2, None, "news", "X", None, None, None, "t"),
            (3, None, "news", "X", None, None, None, "t"), (4, "b", "gold", None, "G", "U", "23", None)]
    df = spark.createDataFrame(rows, "pos bigint, record_id string, type string, source_name string, indicator_code string, country_code string, period string, title string")
    assert sorted(r.pos for r in RS.unique_records(df, "pos").collect()) == [0, 2, 4]
    assert sorted(r.pos for r in RS.bibliography(df, "pos").collect()) == [0, 2]


def test_trust(spark):
    schema = ("dq_score double, accuracy double, completeness double, timeliness double, consistency double, failure_reasons array<string>, dq_status string, "
              "approved_by string, review_status string, reviewed_by string, review_notes string, source_name string, extraction_method string")
    rows = [(100.0, 100.0, 100.0, 100.0, 100.0, [], "AUTO_PROMOTED", "auto", None, None, None, "World Bank", "API_FETCH"),
            (75.0, 20.0, 100.0, 100.0, 100.0, ["value_200.0_above_max_30.0"], "REVIEW", "ann", "APPROVED", "ann", "ok", "IMF", None)]
    high, mid = PV.with_trust(spark.createDataFrame(rows, schema)).orderBy(F.desc("dq_score")).collect()
    assert high.trust_tier == "high" and high.caveats == [] and "No outstanding quality flags." in high.summary
    assert mid.promotion_path == "HUMAN_REVIEW_APPROVED" and mid.trust_tier == "medium" and "Reviewer notes: ok" in mid.caveats
    assert mid.dimensions[0].issues == ["Value 200.0 exceeds the maximum plausible bound (30.0)."]
    assert mid.dimensions[0].weighted_contribution == 8.0


def test_answer_scoring(spark):
    rows = [("a", "point", "numeric", 2.1, None, "World Bank", "It was 2.12% [Source: World Bank, 2023]", ""),
            ("b", "cmp", "categorical", None, "Japan", "IMF", "japan was higher", "IMF WEO"), ("c", "point", "numeric", 50.0, None, "X", "no number", "")]
    df = spark.createDataFrame(rows, "id string, question_type string, answer_kind string, expected_value double, expected_answer string, expected_source string, response string, cited_sources string")
    got = {r.id: (r.correct, r.source_cited) for r in EV.score_answers(df).collect()}
    assert got == {"a": (True, True), "b": (True, True), "c": (False, False)}
    total = EV.answer_rollup(EV.score_answers(df)).filter("question_type = 'ALL'").first()
    assert (total.total, total.accuracy) == (3, 0.6667)


def test_payload_flatteners(spark):
    paged = spark.createDataFrame([("GDP_CURRENT_USD", "USA", '[{"page":1},[{"date":"2020","value":21000000000000},{"date":"","value":1},{"date":"2021","value":null}]]')],
                                  "indicator_code string, country_code string, payload string")
    rows = L.paged_observations(paged).collect()
    assert [(r.period, r.raw_value, r.raw_unit) for r in rows] == [("2020", "21000.0", "USD_BN")]
    nested = spark.createDataFrame([('{"values":{"NGDP_RPCH":{"USA":{"2009":1.0,"2020":-2.2,"x":3},"XXX":{"2020":1}}}}',)], "payload string")
    tracked = spark.createDataFrame([("USA",)], "country_code string")
    got = L.nested_map_observations(nested, tracked, {"NGDP_RPCH": "GDP_GROWTH"}, 2010).collect()
    assert [(r.indicator_code, r.country_code, r.period, float(r.raw_value)) for r in got] == [("GDP_GROWTH", "USA", "2020", -2.2)]
    obs = spark.createDataFrame([("POPULATION", '{"observations":[{"date":"2020-01-01","value":"331500.5"},{"date":"2021-01-01","value":"."}]}')], "indicator_code string, payload string")
    assert [(r.period, float(r.raw_value)) for r in L.observation_list(obs).collect()] == [("2020", 331.5005)]
    out = spark.createDataFrame([(1, '{"note":"x","rows":[{"indicator_code":"G","value":1.0,"confidence":0.3},{"indicator_code":"C","value":2.0}]}'), (2, '[{"indicator_code":"D"}]'), (3, '{"a":1}')], "id bigint, payload string")
    assert sorted((r.id, r.indicator_code) for r in L.extracted_records(out, "id").collect()) == [(1, "C"), (2, "D")]


def test_page_links(spark):
    html = ('<a class="x" href="/blogs/articles/2024/one">First <b>article</b> here</a><a href=\'/Blogs/Articles/2024/one\'>x</a>'
            '<a href="https://x.org/2024/05/06/two">Second article title</a><a href="/blogs/articles/2024/one">Again the first</a><a href="/about">About this site</a>')
    df = spark.createDataFrame([(1, "https://h.org/list?x=1", html)], "page_id bigint, url string, html string")
    got = L.page_links(df).orderBy("rank").collect()
    assert [(r.url, r.title) for r in got] == [("https://h.org/blogs/articles/2024/one", "First article here"), ("https://x.org/2024/05/06/two", "Second article title")]
    assert df.select(L.page_text(F.lit("<p>a<script>x</script>\n b</p>")).alias("t")).first().t == "a b"


def test_sinks(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, w int, v double")
    path = str(tmp_path / "cards")
    base.write.partitionBy("w").parquet(path)
    sinks.upsert_partitions(spark, path, spark.createDataFrame([("b", 1, 5.0), ("c", 1, 6.0)], "k string, w int, v double"), ["k", "w"], "w")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("b", 5.0), ("c", 6.0)]
    parts = str(tmp_path / "parts")
    sinks.replace_partitions(base, parts, ["k"])
    sinks.replace_partitions(spark.createDataFrame([("b", 1, 9.0)], "k string, w int, v double"), parts, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(parts).collect()) == [("a", 1.0), ("b", 9.0)]
    raw = spark.createDataFrame([("FRED", "1"), ("IMF", "2")], "source_code string, raw_value string")
    bronze = str(tmp_path / "bronze")
    for run in ("r1", "r2"):
        sinks.append_bronze(raw, bronze, NOW(), run)
    back = spark.read.parquet(bronze)
    assert back.count() == 4 and back.select("request_id").distinct().count() == 2
    sinks.export_csv(base, str(tmp_path / "csv"))
    sinks.export_json(base, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 2
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "one.json").write_text('{"a":\n 1}')
    assert L.read_payloads(spark, str(landing)).first().payload == '{"a":\n 1}'


def test_revisions_stay_with_their_tenant(spark):
    rows = [(1, 1, 2.0, False), (2, 2, 9.0, False), (3, 1, 3.0, True), (4, None, 5.0, False), (5, 2, 6.0, False), (6, 1, 4.0, False), (7, None, 1.0, False)]
    df = spark.createDataFrame(
        [(i, t, "G", "USA", "2020", v, f, dt.datetime(2024, 1, i)) for i, t, v, f in rows],
        "record_id bigint, tenant_id bigint, indicator_code string, country_code string, period string, value double, is_forecast boolean, promoted_at timestamp_ntz",
    )
    got = {r.record_id: (r.revision_flag, r.revision_delta) for r in M.flag_revisions(df).collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (True, 1.0), 4: (False, None), 5: (True, 1.0), 6: (True, -1.0), 7: (True, -4.0)}


EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string, delivery bigint"


@pytest.mark.parametrize("split", [[1, 1, 1], [2, 1], [3]])
def test_late_publications_are_kept_and_follow_each_other(spark, tmp_path, split):
    from tidemark.session import configure
    from tidemark.streaming import jobs

    configure(spark)
    day = dt.datetime(2024, 1, 20)
    rows = [
        (1, day, 1, "a", 7.0, 1), (2, day + dt.timedelta(days=9), 2, "a", 1.0, 1),
        (3, day + dt.timedelta(hours=1), 1, "a", 8.0, 2), (4, day - dt.timedelta(days=3), 9, "b", 5.0, 2),
        (5, day + dt.timedelta(hours=2), 1, "a", 8.5, 3), (6, day - dt.timedelta(days=3), 9, "b", 5.0, 3),
    ]
    landing, at = str(tmp_path / "landing"), 0
    for n in split:
        for delivery in range(at + 1, at + n + 1):
            spark.createDataFrame([(*r[:5], None, r[5]) for r in rows if r[5] == delivery], EVENT).coalesce(1).write.mode("append").parquet(landing)
        at += n
        jobs.published_revisions(spark, landing, str(tmp_path / "out"))
    got = {r.event_id: (r.old_value, r.revision_flag, r.late) for r in jobs.with_lateness(spark.read.parquet(str(tmp_path / "out/published")).drop("batch")).collect()}
    assert got == {
        1: (None, False, False), 2: (None, False, False), 3: (7.0, True, True), 4: (None, False, True), 5: (8.0, True, True), 6: (5.0, True, True),
    }


def test_stream_limits_late_hits_by_their_own_day(spark, tmp_path):
    from tidemark.session import configure
    from tidemark.streaming import stateful

    configure(spark)
    schema = "hit_id bigint, identifier bigint, role string, hit_at timestamp_ntz"
    second = dt.datetime(2024, 1, 2, 9)
    first = [(i, 1, "PUBLIC", second + dt.timedelta(minutes=5 * i)) for i in range(10)]
    # Of the second batch, one hit is a day old, two are forty days younger and three as much older.
    later = [(10, 1, "PUBLIC", dt.datetime(2024, 1, 1, 9)), (11, 1, "PUBLIC", second + dt.timedelta(hours=5))]
    later += [(12 + i, 1, "PUBLIC", second + dt.timedelta(days=40, seconds=i)) for i in range(2)]
    later += [(14 + i, 1, "PUBLIC", second - dt.timedelta(days=40, seconds=i)) for i in range(3)]
    landing, out = str(tmp_path / "hits"), str(tmp_path / "out")
    for part in (first, later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        run = (
            stateful.limit_hits(spark.readStream.schema(schema).parquet(landing)).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    got, batch = limit_rows(spark.read.parquet(out)), limit_rows(limits.decide(spark.createDataFrame(first + later, schema)))
    assert got == batch and not got[11][0] and got[10][0]


HITS = "hit_id bigint, identifier bigint, role string, hit_at timestamp_ntz"


def limited(spark, tmp_path, batches):
    """Decisions on micro-batches in order, and the progress of the last one."""
    from tidemark.session import configure
    from tidemark.streaming import stateful

    configure(spark)
    landing, out = str(tmp_path / "hits"), str(tmp_path / "out")
    for part in batches:
        spark.createDataFrame(part, HITS).coalesce(1).write.mode("append").parquet(landing)
        run = (
            stateful.limit_hits(spark.readStream.schema(HITS).parquet(landing)).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    return spark.read.parquet(out), run.lastProgress


def test_stream_limits_write_few_state_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 9)
    rows = [(100 * i + d, i, "PUBLIC", start + dt.timedelta(days=d)) for i in range(3) for d in range(60)]
    got, progress = limited(spark, tmp_path, [rows])
    assert limit_rows(got) == brute_limits(rows)
    assert progress["stateOperators"][0]["numRowsUpdated"] <= 3 * 3  # not one for each day


def test_stream_limits_over_batches_with_nulls_and_large_identifiers(spark, tmp_path):
    rng, rows = random.Random(9), []
    for ident in (None, 0, 2**60, 2**60 + 1, -7):
        t = dt.datetime(2024, 1, 31, 23, 40)
        for _ in range(120):
            t += dt.timedelta(seconds=rng.choice([0, 1, 5, 20, 61]), microseconds=rng.randrange(10**6))
            rows.append((2**60 + len(rows), ident, {0: "EXTERNAL_BUSINESS", -7: None}.get(ident, "PUBLIC"), t))
    rows.sort(key=lambda r: r[3])
    got, _ = limited(spark, tmp_path, [rows[:150], rows[150:400], rows[400:]])
    each = [brute_limits([r for r in rows if r[1] == ident]) for ident in {r[1] for r in rows}]
    assert limit_rows(got) == {hit: decided for part in each for hit, decided in part.items()}
    assert {r.hit_id: r.identifier for r in got.collect()} == {r[0]: r[1] for r in rows}


def test_stream_limits_many_hits_of_one_identifier_and_hits_without_id(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 5, "ADMIN", start + dt.timedelta(milliseconds=i)) for i in range(25_000)]
    rows += [(i, 6, "PUBLIC", start + dt.timedelta(seconds=10 * i)) for i in range(30)] + [(None, 6, "PUBLIC", start)]
    got = limited(spark, tmp_path, [rows])[0].collect()
    assert len(got) == len(rows)
    assert sum(r.allowed for r in got if r.identifier == 5) == 999  # the minute's burst
    assert [(r.allowed, r.minute_remaining) for r in got if r.hit_id is None] == [(True, 0)]  # after the hit of its time that has an id


def test_a_retrieved_zero_supports_numbers_below_the_tolerance_only(spark):
    answers = spark.createDataFrame([(1, "It was 0.05 then."), (2, "It was 0.049 then.")], "run_id bigint, text string")
    values = spark.createDataFrame([(1, 0.0), (2, 0.0)], "run_id bigint, value double")
    got = {r.run_id: r.n_unmatched for r in RS.grounding(answers, values, "run_id").collect()}
    assert got == {1: 1, 2: 0}


def test_crawl_decision_takes_the_first_match(spark):
    day = dt.datetime(2024, 1, 1)
    log = [
        (1, "s", "PROCEED", "e1", "m1", "h1"), (2, "s", "SKIP", "e1", "m9", "h9"), (3, "s", "SKIP", "e2", "m1", "h9"),
        (4, "s", "SKIP", "e2", "m2", "h9"), (5, "s", "PROCEED", "e2", "m2", "h5"), (6, "s", "SKIP", "", None, "h6"),
    ]
    df = spark.createDataFrame(
        [(i, s, a, e, m, h, day + dt.timedelta(minutes=20 * i)) for i, s, a, e, m, h in log],
        "log_id bigint, source_code string, action string, etag string, last_modified string, content_hash string, logged_at timestamp_ntz",
    )
    got = {r.log_id: r.reason for r in U.crawl_decision(df).collect()}
    assert got == {1: "change detected", 2: "etag match", 3: "last_modified match", 4: "content hash match", 5: "change detected", 6: "change detected"}
