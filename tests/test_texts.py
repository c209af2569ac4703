"""Texts for clients and advisors."""

from nextcover.operators import advisor, explain

CONTRIBUTIONS = "party_id string, product string, feature string, contribution double, value string"


def test_narrative(spark):
    predictions = spark.createDataFrame(
        [("c", "RETIREMENT", 0.812, 57, 12.5), ("d", "HEALTH", 0.4, None, None)],
        "party_id string, predicted_product string, pred_prob double, psn_age int, client_tenure double")
    rows = spark.createDataFrame(
        [("c", "RETIREMENT", "hist_9", 0.9, "4"), ("c", "RETIREMENT", "last_1", 0.8, "0"), ("c", "RETIREMENT", "freq_3", 0.7, "2"),
         ("c", "RETIREMENT", "psn_age", 0.6, "0"), ("c", "RETIREMENT", "client_tenure", 0.5, "0"),
         ("c", "RETIREMENT", "freq_2", -0.2, "1"), ("c", "RETIREMENT", "aum_band", -0.05, "1")], CONTRIBUTIONS)
    out = {r.party_id: r for r in explain.narrative(predictions, explain.signed_contributions(rows), {3: "INVESTMENT", 4: "LIFE_INSURANCE"}).collect()}
    lines = out["c"].talking_points.split("\n")
    assert lines[0].endswith("we recommend RETIREMENT with 81.2% confidence.")
    assert "  1. Your recent purchase of LIFE_INSURANCE indicates strong alignment with RETIREMENT." in lines
    assert not any(line.startswith("  2.") for line in lines)
    assert "  3. Your frequent engagement with INVESTMENT indicates readiness for RETIREMENT." in lines
    assert any(line.startswith("  4. At age 57, ") for line in lines)
    assert any(line.startswith("  5. With 12.5 years as our client") for line in lines)
    assert sum(line.startswith("  - ") for line in lines) == 1
    assert out["c"].top_positive_features == "hist_9, last_1, freq_3"
    assert out["c"].top_negative_features == "freq_2, aum_band"
    assert "Key reasons" not in out["d"].talking_points and "Next Steps" in out["d"].talking_points


def test_reasoning(spark):
    predictions = spark.createDataFrame([("c", "R", 0.6)], "party_id string, predicted_product string, pred_prob double")
    rows = spark.createDataFrame([("c", "R", "stock_allocation_ratio", 0.12, "0.256"), ("c", "R", "face_amt", -0.07, "1234.4")], CONTRIBUTIONS)
    chances = spark.createDataFrame([("c", "R", 0.6), ("c", "I", 0.3), ("c", "L", 0.1)], "party_id string, class string, probability double")
    text = explain.reasoning_text(
        explain.display_value(explain.signed_contributions(rows)), predictions, explain.alternatives(chances)).first().reasoning_text
    assert "1. **stock_allocation_ratio** = 25.6% (🔥 High impact: +0.1200)" in text
    assert "1. **face_amt** = $1,234 (reducing confidence: -0.0700)" in text
    assert "**Moderate Confidence (60.0%)**" in text
    assert "- **I**: 30.0% probability (gap: 30.0%)" in text


def test_what_tells_the_alternative_apart(spark):
    predictions = spark.createDataFrame([("c", "R", 0.6), ("d", "R", 0.9)], "party_id string, predicted_product string, pred_prob double")
    rows = spark.createDataFrame([("c", "R", "face_amt", 0.1, "1234.4"), ("c", "I", "face_amt", -0.25, "1234.4"), ("c", "R", "flag", 0.2, None), ("c", "I", "flag", 0.2, None)], CONTRIBUTIONS)
    chances = spark.createDataFrame([("c", "R", 0.6), ("c", "I", 0.3)], "party_id string, class string, probability double")
    others = explain.alternatives(chances)
    apart = explain.alternative_reasons(explain.display_value(rows), others)
    texts = {r.party_id: r.reasoning_text for r in explain.reasoning_text(
        explain.display_value(explain.signed_contributions(rows.filter("product = 'R'"))), predictions, others, apart).collect()}
    assert texts["c"].endswith("**Key Differences from Top Alternative:**\n- **face_amt** = $1,234 (contribution difference: -0.3500)\n"
                               "- **flag** = None (contribution difference: +0.0000)")
    assert "Key Differences" not in texts["d"]


def test_advice_of_an_encoded_feature_is_that_of_its_base(spark):
    rules = {"channel": [(None, "any channel", "Call")], "channel_Direct": [(None, "direct", "Visit")], "age": [(("=", "1"), "young", "Wait")]}
    rows = spark.createDataFrame([("c", "R", f, 0.2, "1") for f in ("channel", "channel_Direct", "channel_Direct_2", "channel_Web", "agent", "age")], CONTRIBUTIONS)
    got = {r.feature: r.enhanced_talking_point.partition(" (")[2] for r in explain.talking_point_ext(rows, {}, rules).collect()}
    assert got["channel"] == got["channel_Web"] == "any channel) → Call"
    assert got["channel_Direct"] == got["channel_Direct_2"] == "direct) → Visit"
    assert got["agent"] == "impact: +0.200)" and got["age"] == "young) → Wait"


def test_age_groups_are_right_closed(spark):
    df = spark.createDataFrame([(35, "R"), (36, "R"), (100, "R"), (101, "R"), (None, "R")], "psn_age int, recommended_product string")
    assert sorted((r.age_group, r.n) for r in advisor.by_age_group(df).collect()) == [("35-50", 1), ("65+", 1), ("<35", 1)]
