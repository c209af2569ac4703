from datetime import date

from pyspark.sql import functions as F

from conftest import rows
from nextcover.functions import classify as c
from nextcover.functions import columns as k
from nextcover.operators import features as fe


def test_codes_lose_leading_zeros_only(spark):
    df = spark.createDataFrame([("0012",), ("0100",), ("00",), ("a0b",)], "x string")
    assert [r[0] for r in df.select(k.normalize_code("x")).collect()] == ["12", "100", "", "A0B"]


def test_month_steps_cross_the_year(spark):
    df = spark.createDataFrame([(200201,), (200112,), (200106,)], "m int")
    assert [r[0] for r in df.select(k.shift_month("m", -1)).collect()] == [200112, 200111, 200105]
    assert [r[0] for r in df.select(k.shift_month("m", 12)).collect()] == [200301, 200212, 200206]


def test_ratio_and_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(k.ratio("a", "b")).collect()] == [0.5, None, None]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (2.0,)], "x double")
    assert [r[0] for r in odd.select(k.finite("x")).collect()] == [None, None, 2.0]


def test_category_golden_rows(spark):
    cases = [
        ("LIFE", "VLI", "VARIABLE LIFE", "LIFE_INSURANCE"),
        ("BROKER DEALER", "INVESTMENT PRODUCT - DIRECT", "Investment Account", "INVESTMENT"),
        ("GROUP RETIREMENT", "RETIREMENT 401K", "401K Plan", "RETIREMENT"),
        ("OTHERS", "OTHERS", None, "HEALTH"),
        ("GROUP RETIREMENT", "EQUIVEST", "EQUIVEST 403B/457", "RETIREMENT"),
        ("OTHERS", "HAS", None, "DISABILITY"),
        ("NETWORK", None, None, "NETWORK_PRODUCTS"),
        (None, None, None, "OTHER"),
        # level 2 outranks the retirement line of business; upper case does not match '%Investment%'
        ("GROUP RETIREMENT", None, "WHOLE LIFE", "LIFE_INSURANCE"),
        (None, None, "INVESTMENT", "OTHER"),
    ]
    df = spark.createDataFrame(cases, "prod_lob string, sub_product_level_1 string, sub_product_level_2 string, expected string")
    got = c.classify(df).filter(~F.col("product_category").eqNullSafe(F.col("expected")))
    assert got.count() == 0


def test_product_text_and_null_second(spark):
    df = spark.createDataFrame(
        [("p1", None, None, None, "Roth IRA"), (None, None, None, None, None)],
        "second_policy_no string, prod_lob string, sub_product_level_1 string, sub_product_level_2 string, product string")
    label = c.product_category(product="product", null_when="second_policy_no IS NULL")
    assert [r[0] for r in df.select(label).collect()] == ["RETIREMENT", None]


def test_nested_sub_categories(spark):
    df = spark.createDataFrame(
        [("LIFE", "UL/IUL", "INDEX UNIVERSAL LIFE", None), ("LIFE", None, None, "Whole Life 100"),
         ("BROKER DEALER", None, None, "SAM advisory"), (None, "ACCUMULATOR", None, None)],
        "prod_lob string, sub_product_level_1 string, sub_product_level_2 string, product string")
    got = [tuple(r) for r in c.classify(df, "product").select(
        "life_sub_category", "investment_sub_category", "retirement_sub_category").collect()]
    assert got == [("LIFE_INDEXED_UNIVERSAL", None, None), ("LIFE_WHOLE", None, None),
                   (None, "INVESTMENT_ADVISORY", None), (None, None, "RETIREMENT_ANNUITY")]


def test_feature_counts_and_leakage():
    from nextcover.operators.clean import assert_no_leakage, exclude_leakage

    names = [n for g in fe.FLAG_GROUPS.values() for n in g]
    assert len(names) == 74 and len(fe.LABEL_FEATURES) == 59
    safe = exclude_leakage([*names, "acct_val_amt", "policy_no_lead", "cross_sell_life_sub", "investment_cross_sell"], fe.LABEL_FEATURES)
    assert len(safe) == 16 and "acct_val_amt" in safe
    assert_no_leakage(safe, fe.LABEL_FEATURES)
    for late in ("quick_cross_sell", "medium_timing_cross_sell", "delayed_cross_sell", "very_delayed_cross_sell"):
        assert late not in safe


def test_bands_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (10000.0,), (10000.5,), (200000.0,), (None,)], "x double")
    assert [r[0] for r in df.select(fe.amount_band("x")).collect()] == [None, "Low", "Medium", "Very High", None]
    segment = [r[0] for r in df.select(fe.aum_segment("x")).collect()]
    assert segment == ["LOW", "LOW", "LOW", "HIGH", "ULTRA_HIGH"]


def test_age_and_season(spark):
    df = spark.createDataFrame([(date(1960, 1, 1), date(2001, 5, 3))], "birth_dt date, register_date date")
    got = fe.ages(df, "2002-01-01").select("client_age", fe.season("register_date").alias("s")).first()
    assert (got.client_age, got.s) == (42, "Q2")
    assert rows(df.select(fe.season("register_date"))) == [("Q2",)]
