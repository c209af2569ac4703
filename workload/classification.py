"""Product categories, sub-categories and target flags."""

from pyspark.sql import functions as F

from nextcover.functions import classify as c
from nextcover.operators import policies as pol
from nextcover.operators.clean import active
from nextcover.operators.client360 import join_product_lookup
from nextcover.plans import next_product
from workload.registry import query
from workload.sqltext import SUB_TARGETS_SQL, TARGETS_SQL


def with_product(t):
    return join_product_lookup(t.policies, t.lookup)


@query("CLS-1", "SELECT policy_no, product_category FROM v_class3")
def category_from_three_fields(t):
    return c.classify(t.policies).select("policy_no", "product_category")


@query("CLS-2", "SELECT policy_no, product_category FROM v_class4")
def category_from_four_fields(t):
    return with_product(t).select("policy_no", c.product_category(product="product").alias("product_category"))


@query("CLS-3", """
SELECT party_id, policy_no, second_policy_no, product_category, second_product_category FROM v_fs""")
def category_of_second_policy(t):
    return next_product.first_second(t.policies, t.lookup, next_product.RULE_FIELDS, next_product.RULE_FIELDS).select(
        "party_id", "policy_no", "second_policy_no", "product_category", "second_product_category")


@query("CLS-4 CLS-5 CLS-6", """
SELECT policy_no, retirement_sub_category, life_sub_category, investment_sub_category FROM v_class4""")
def sub_categories(t):
    return c.classify(with_product(t), "product").select(
        "policy_no", "retirement_sub_category", "life_sub_category", "investment_sub_category")


@query("CLS-7 CLS-8 CLS-9", "SELECT policy_no, tax_treatment, investment_type, account_type FROM v_class4")
def product_characteristics(t):
    return c.classify(with_product(t), "product").select("policy_no", "tax_treatment", "investment_type", "account_type")


@query("CLS-10 CLS-11", f"SELECT party_id, policy_no, {TARGETS_SQL}, {SUB_TARGETS_SQL} FROM v_neighbour WHERE rnk = 1")
def cross_sell_targets(t):
    near = pol.neighbour_policy(c.classify(with_product(t), "product")).filter("rnk = 1")
    flagged = c.sub_target_flags(c.target_flags(near))
    return flagged.select("party_id", "policy_no", *[f"{x.lower()}_cross_sell" for x in c.TARGET_CATEGORIES], *c.SUB_TARGETS)


@query("CLS-12", """
SELECT CASE WHEN product_category IN ('DISABILITY', 'HEALTH') THEN 'OTHER_HEALTH' ELSE product_category END AS product_category,
  count(*) AS n FROM v_class3 GROUP BY 1""")
def merged_rare_classes(t):
    merged = c.merge_classes(c.classify(t.policies), "product_category", {"DISABILITY": "OTHER_HEALTH", "HEALTH": "OTHER_HEALTH"})
    return merged.groupBy("product_category").agg(F.count(F.lit(1)).alias("n"))


@query("CLS-13", "SELECT count(*) AS total, " + ", ".join(
    f"count(CASE WHEN product_category = '{x}' THEN 1 END) AS {x.lower()}" for x in c.CATEGORIES) + " FROM v_class3")
def category_share_check(t):
    return c.category_counts(c.classify(t.policies))


@query("AGG-7", "SELECT party_id, " + ", ".join(
    f"count(CASE WHEN product_category = '{x}' THEN 1 END) AS {x.lower()}_policies" for x in c.CATEGORIES)
    + " FROM v_class3 WHERE policy_status = 'Active' GROUP BY party_id")
def portfolio_per_client(t):
    from nextcover.operators.client360 import portfolio_counts

    return portfolio_counts(active(c.classify(t.policies)), c.CATEGORIES)
