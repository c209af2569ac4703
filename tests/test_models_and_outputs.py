import pytest
from pyspark.sql import functions as F

from conftest import rows
from nextcover.operators import advisor, explain, models as m, monitor, propensity as pr, quality, scoring as sc


def test_report_from_counts(spark):
    counts = spark.createDataFrame([("a", "a", 8), ("a", "b", 2), ("b", "a", 1), ("b", "b", 3), ("c", "a", 1)], "label string, prediction string, n long")
    report = {r["class"]: r for r in m.report_from_counts(counts).collect()}
    assert report["a"].precision == pytest.approx(0.8) and report["a"].recall == pytest.approx(0.8)
    assert report["b"].f1 == pytest.approx(2 * 3 / (4 + 5)) and report["c"].f1 == 0 and report["c"].support == 1
    total = m.metrics_from_report(m.report_from_counts(counts)).first()
    assert total.accuracy == pytest.approx(11 / 15) and total.rows == 15


def test_thresholds_prefer_the_lowest_best(spark):
    long = spark.createDataFrame(
        [(i, "a", p, "a" if p > 0.42 else "b") for i, p in enumerate([0.1, 0.2, 0.31, 0.43, 0.5, 0.9])]
        + [(i, "b", 0.05, "a") for i in range(6)], "k int, class string, probability double, label string")
    best = {r["class"]: r for r in m.tune_thresholds(long).collect()}
    assert best["a"].threshold == pytest.approx(0.35) and best["a"].f1 == 1.0
    assert best["b"].threshold == 0.5 and best["b"].f1 == 0.0
    wide = long.groupBy("k").pivot("class", ["a", "b"]).agg({"probability": "max"})
    got = m.apply_thresholds(wide, {"a": "a", "b": "b"}, m.tune_thresholds(long))
    assert rows(got, "k", "prediction") == [(i, "a") for i in range(6)]
    higher = spark.createDataFrame([("a", 0.6), ("b", 0.04)], "class string, threshold double")
    passing = m.apply_thresholds(wide, {"a": "a", "b": "b"}, higher)
    assert rows(passing, "k", "prediction") == [(i, "b") for i in range(5)] + [(5, "a")]


def test_transition_golden(spark):
    pairs = [("R", "R")] * 462 + [("R", "I")] * 340 + [("R", "L")] * 198
    df = spark.createDataFrame(pairs, "product_category string, second_product_category string")
    got = {r.second_prod: r.transition_probability for r in pr.top_transitions(pr.transition_probs(df), 2).collect()}
    assert got == {"R": pytest.approx(0.462), "I": pytest.approx(0.34)}


def test_talking_points(spark):
    df = spark.createDataFrame(
        [("c", "p", "client_age", 0.12, "57", 1), ("c", "p", "acct_val_amt", -0.06, "60000", 2), ("c", "p", "unknown", 0.01, "7", 3),
         ("c", "p", "feature_12", 0.2, "1", 4), ("c", "p", "channel", 0.2, "Advisor Assist/Retail", 5), ("c", "p", "snp_close_lead_6", 0.2, "-3.25", 6)],
        "party_id string, product string, feature string, contribution double, value string, rank int")
    points = {r.feature: r.talking_point for r in explain.talking_point(df).collect()}
    assert points["client_age"] == "+++ Age 57"
    assert points["acct_val_amt"] == "++ Account value of $60,000"
    assert points["unknown"] == "+ unknown: 7"
    assert points["feature_12"] == "+++ Model factor (impact: 0.200, value: 1)"
    long = {r.feature: r.enhanced_talking_point for r in explain.talking_point_ext(df).collect()}
    assert long["acct_val_amt"] == "⭐ Account value of $60,000 (strong capacity) → Discuss portfolio diversification"
    assert long["channel"] == "🔥 Channel: Advisor Assist/Retail (advisor relationship) → Leverage advisor trust"
    assert long["snp_close_lead_6"].endswith("(market correction opportunity) → Position for recovery")
    assert long["unknown"] == " unknown: 7 (impact: +0.010)"
    wide = explain.talking_points_wide(explain.talking_point(df.filter("feature <> 'unknown'"))).first()
    assert wide.talking_point_3.startswith("+++ Model factor")


def test_pitch_by_gap(spark):
    df = spark.createDataFrame(
        [("a", 0.90, 0.70, 0.1, 0.1), ("b", 0.90, 0.87, 0.1, 0.1), ("c", 0.90, 0.80, 0.1, 0.1)],
        "party_id string, investment_score double, retirement_score double, life_insurance_score double, network_products_score double"
    ).withColumn("prediction_month", F.lit(200112))
    none = spark.createDataFrame([], "party_id string, prediction_month int, product string, talking_points array<string>")
    got = rows(advisor.strategy(sc.opportunity_flags(sc.best_two(df)), none), "party_id", "pitch_strategy")
    assert got == [("a", advisor.PITCH_FOCUS), ("b", advisor.PITCH_DUAL), ("c", advisor.PITCH_LEAD)]


def test_missing_scores_do_not_compete(spark):
    df = spark.createDataFrame([("a", None, 0.4, None, 0.4)], "party_id string, investment_score double, retirement_score double, life_insurance_score double, network_products_score double")
    r = sc.best_two(df).first()
    assert (r.best_product, r.second_best_product, r.best_score) == ("retirement", "network_products", 0.4)


def test_one_hot_names_use_the_longest_base(spark):
    df = spark.createDataFrame(
        [("c", "p", "channel_Direct", 0.1, "1"), ("c", "p", "channel_Branch", 0.2, "0"), ("c", "p", "channel_type_X", 0.5, "1"), ("c", "p", "age", -0.1, "40")],
        "party_id string, product string, feature string, contribution double, value string")
    got = {r.feature: (round(r.contribution, 6), r.value) for r in explain.to_base_feature(df, ["channel", "channel_type", "age"]).collect()}
    assert got == {"channel": (0.3, "Direct"), "channel_type": (0.5, "X"), "age": (-0.1, "40")}


def test_outcome_in_january(spark):
    predictions = spark.createDataFrame([("a", "L", "R", 0.9, 200112), ("b", "L", "I", 0.9, 200112), ("z", "L", "I", 0.9, 200111)],
                                        "party_id string, first_product_category string, predicted_product string, pred_prob double, business_month int")
    current = spark.createDataFrame([("a", "L"), ("a", "R"), ("b", "L"), ("z", "L"), ("z", "I")], "party_id string, product_category string")
    got = rows(monitor.prediction_outcome(predictions, current, 200201), "party_id", "actual_product_bought", "prediction_match")
    assert got == [("a", "R", "Match")]


def test_monthly_change_skips_gaps(spark):
    df = spark.createDataFrame([("a", 200111, 10.0), ("a", 200112, 20.0), ("a", 200202, 30.0)], "party_id string, business_month int, aum double")
    got = {r.business_month: (r.aum_1m_ago, r.aum_change_1m_pct, r.aum_3m_ago) for r in monitor.monthly_change(df, ["aum"]).collect()}
    assert got == {200111: (None, None, None), 200112: (10.0, 100.0, None), 200202: (None, None, 10.0)}


def test_drift_is_zero_for_equal_months(spark):
    df = spark.createDataFrame([(float(i),) for i in range(200)], "x double")
    assert monitor.drift(df, df, ["x"]).first().psi == pytest.approx(0.0)
    assert monitor.drift(df, df.withColumn("x", F.col("x") + 100), ["x"]).first().psi > 1


def test_outliers_and_correlation_of_constants(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in [*range(20), 500]], "x double, k double")
    out = {r.column: r for r in quality.outlier_report(df, ["x", "k"]).collect()}
    assert out["x"].outlier_count == 1 and out["k"].outlier_count == 0
    assert quality.corr_matrix(df, ["x", "k"]).first().corr is None


def test_decode_predictions(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([([0.2, 0.5, 0.3],)], "p array<double>").withColumn("probability", array_to_vector("p"))
    r = sc.decode_predictions(df, ["a", "b", "c"]).first()
    assert (r.predicted_product, r.pred_prob, r.prob_c) == ("b", 0.5, 0.3)
