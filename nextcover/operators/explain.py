"""Explanations as long rows (client, product, feature, contribution, value).

A client has one row per model feature and product, so per-client lists are bounded by the
number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextcover.functions.columns import money, percent, signed
from nextcover.operators.ordered import first_by
from nextcover.operators.quantiles import with_fitted

# ---- fixed values: texts, limits and feature groups of the explanations ----
# feature: (text before the value, how the value is written, text after it)
TEMPLATES = {
    "acct_val_amt": ("Account value of ", "money", ""),
    "wc_total_assets": ("Total assets of ", "money", ""),
    "aum_segment": ("AUM tier: ", "text", ""),
    "wc_assetmix_stocks": ("Stock allocation: ", "money", ""),
    "wc_assetmix_bonds": ("Bond allocation: ", "money", ""),
    "wc_assetmix_mutual_funds": ("Mutual fund allocation: ", "money", ""),
    "wc_assetmix_deposits": ("Deposit allocation: ", "money", ""),
    "aggressive_investor": ("Aggressive risk profile", "none", ""),
    "conservative_investor": ("Conservative risk profile", "none", ""),
    "client_age": ("Age ", "whole", ""),
    "retirement_planning_trigger": ("Retirement planning phase", "none", ""),
    "wealth_building_trigger": ("Wealth building phase", "none", ""),
    "family_protection_trigger": ("Family protection phase", "none", ""),
    "monthly_premium_amount": ("Premium capacity: ", "money", "/month"),
    "face_amt": ("Current coverage: ", "money", ""),
    "cash_val_amt": ("Cash value: ", "money", ""),
    "snp_close_lead_6": ("S&P 6-month trend: ", "signed", "%"),
    "snp_close_lead_12": ("S&P 12-month trend: ", "signed", "%"),
    "snp_close_variation": ("Market volatility: ", "fixed", ""),
    "client_tenure_years": ("", "whole", " years with us"),
    "channel": ("Channel: ", "text", ""),
    "product_category": ("First product: ", "text", ""),
    "advisor_investment_affinity": ("Strong advisor-investment relationship", "none", ""),
    "branch_retirement_affinity": ("Branch retirement expertise", "none", ""),
}
# feature: ordered (condition on the value, context, action); the first that holds is used
ADVICE = {
    "acct_val_amt": [
        ((">", 50000), "strong capacity", "Discuss portfolio diversification"),
        ((">", 25000), "good capacity", "Discuss portfolio diversification"),
        (None, "moderate capacity", "Discuss portfolio diversification")],
    "wc_total_assets": [
        ((">", 100000), "high net worth client", "Explore comprehensive wealth planning"),
        (None, "substantial assets", "Explore comprehensive wealth planning")],
    "aum_segment": [
        (("=", "HIGH"), "premium client segment", "White-glove service approach"),
        (None, "core client segment", "Standard advisory approach")],
    "wc_assetmix_stocks": [(None, "equity-focused portfolio", "Position growth products")],
    "aggressive_investor": [(None, "high-growth orientation", "Emphasize equity and growth opportunities")],
    "conservative_investor": [
        (None, "capital preservation focus", "Highlight stability and guaranteed products")],
    "client_age": [
        ((">", 55), "retirement planning window", "Focus on retirement readiness"),
        ((">", 40), "wealth accumulation phase", "Emphasize long-term growth"),
        (None, "early career", "Emphasize long-term growth")],
    "retirement_planning_trigger": [
        (None, "active retirement preparation", "Lead with retirement income solutions")],
    "snp_close_lead_6": [
        ((">", 0), "positive market momentum", "Act on current strength"),
        (None, "market correction opportunity", "Position for recovery")],
    "channel": [
        (("contains", "Advisor"), "advisor relationship", "Leverage advisor trust"),
        (None, "direct channel", "Personal outreach approach")],
    "client_tenure_years": [
        ((">", 10), "long-standing relationship", "Deepen existing relationship"),
        ((">", 5), "established client", "Deepen existing relationship"),
        (None, "newer client", "Build trust and engagement")],
}
IMPACT_HIGH, IMPACT_MEDIUM = 0.1, 0.05
FEATURE_CATEGORIES = {
    "Wealth Indicators": ["acct_val_amt", "wc_total_assets", "aum_segment"],
    "Asset Mix": ["wc_assetmix_stocks", "wc_assetmix_bonds", "wc_assetmix_mutual_funds", "wc_assetmix_deposits"],
    "Risk Profile": ["aggressive_investor", "conservative_investor"],
    "Demographics": ["client_age", "client_tenure_years"],
    "Life Triggers": ["retirement_planning_trigger", "wealth_building_trigger", "family_protection_trigger"],
    "Market Timing": ["snp_close_lead_6", "snp_close_lead_12", "snp_close_variation"],
    "Insurance": ["monthly_premium_amount", "face_amt", "cash_val_amt"],
    "Channel & Relationship": [
        "channel", "product_category", "advisor_investment_affinity", "branch_retirement_affinity"],
}
FEATURE_PAIRS = [
    ("acct_val_amt", "aggressive_investor", "High wealth + Aggressive = Prime for growth products"),
    ("client_age", "retirement_planning_trigger", "Age + Retirement phase = Urgent retirement planning need"),
    ("wc_assetmix_stocks", "snp_close_lead_6", "Stock allocation + Market momentum = Market timing opportunity"),
    ("aum_segment", "advisor_investment_affinity", "High AUM + Advisor relationship = Premium service opportunity"),
    ("conservative_investor", "client_age", "Conservative profile + Older age = Capital preservation focus"),
    ("face_amt", "family_protection_trigger", "Existing coverage + Family phase = Additional protection need"),
    ("wc_total_assets", "client_tenure_years", "High assets + Long tenure = Deep relationship opportunity"),
]
PAIR_CRITICAL, PAIR_HIGH = 0.15, 0.10
VERY_CONSISTENT, MODERATELY_CONSISTENT = 0.005, 0.01
# ---- end of fixed values ----

CLIENT_PRODUCT = ["party_id", "product"]


def linear_contributions(df: DataFrame, model: dict, means: DataFrame, product: str, key: str = "party_id") -> DataFrame:
    """Exact contributions of a linear model: coefficient times distance from the mean.

    ``model`` maps feature to coefficient, ``means`` is the one-row frame of training means.
    """
    features = list(model)
    named = with_fitted(df.select(key, *features), means.select(*features)).select(key, *[
        F.expr(
            f"named_struct('contribution', {float(model[f])!r}D * (coalesce(double({f}), _fit.{f}) - _fit.{f}), "
            f"'value', string({f}))").alias(f)
        for f in features
    ])
    long = named.unpivot([key], features, "feature", "c")
    return long.select(key, F.lit(product).alias("product"), "feature", "c.contribution", "c.value")


def logistic_coefficients(model, features: list[str]) -> dict[str, float]:
    """Coefficients of a fitted logistic pipeline by feature name."""
    return dict(zip(features, [float(c) for c in model.stages[-1].coefficients]))


def feature_means(train: DataFrame, features: list[str]) -> DataFrame:
    return train.agg(*[F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in features])


def _strongest() -> list[Column]:
    return [F.abs("contribution").desc(), F.col("feature").asc()]


def top_contributions(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` strongest contributions per client and product, ranked by absolute value."""
    return first_by(df, CLIENT_PRODUCT, _strongest(), k, rank="rank")


def signed_contributions(df: DataFrame, positive: int = 5, negative: int = 3) -> DataFrame:
    """The strongest supporting and opposing contributions, ranked on their own side."""
    sided = df.filter(F.col("contribution") != 0).withColumn(
        "side", F.when(F.col("contribution") > 0, "positive").otherwise("negative"))
    ranked = first_by(sided, [*CLIENT_PRODUCT, "side"], _strongest(), max(positive, negative), rank="rank")
    return ranked.filter(F.col("rank") <= F.when(F.col("side") == "positive", positive).otherwise(negative))


def contribution_importance(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean absolute contribution per feature with its rank, overall or per ``by``."""
    by = by or []
    means = df.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    # one row per feature and product
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.round("importance", 9).desc())
    return means.withColumn("rank", F.rank().over(order))


def compare_importance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two importance tables side by side, a missing feature counted as zero."""
    left = a.select("feature", F.col("importance").alias("importance_a"))
    right = b.select("feature", F.col("importance").alias("importance_b"))
    return left.join(right, "feature", "full").fillna(0.0).withColumn(
        "difference", F.col("importance_b") - F.col("importance_a"))


def cumulative_importance(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Running share of importance, and the number of features that reach ``share``."""
    # one row per feature
    whole = Window.partitionBy(F.lit(1))
    running = whole.orderBy(F.desc("importance"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    out = df.select("feature", "importance").withColumn(
        "cumulative_share", F.sum("importance").over(running) / F.sum("importance").over(whole))
    reached = F.sum((F.col("cumulative_share") < share).cast("long")).over(whole) + 1
    return out.withColumn("features_needed", reached)


def plus_marks(c: str = "contribution") -> Column:
    size = F.abs(F.col(c))
    return F.when(size > IMPACT_HIGH, "+++").when(size > IMPACT_MEDIUM, "++").otherwise("+")


def impact_marks(c: str = "contribution") -> Column:
    size = F.abs(F.col(c))
    return F.when(size > IMPACT_HIGH, "🔥").when(size > IMPACT_MEDIUM, "⭐").otherwise("")


def _written(kind: str) -> Column:
    number = F.col("value").try_cast("double")
    return {
        "money": money(number), "whole": F.format_string("%.0f", number), "signed": signed(number, 1),
        "fixed": F.format_string("%.2f", number), "text": F.col("value"), "none": F.lit(""),
    }[kind]


def base_text(templates: dict | None = None) -> Column:
    """The feature's sentence; null for features without a template or unreadable values."""
    out = F.when(F.lit(False), F.lit(""))
    for feature, (before, kind, after) in (templates or TEMPLATES).items():
        readable = F.lit(True) if kind in ("text", "none") else F.col("value").try_cast("double").isNotNull()
        out = out.when((F.col("feature") == feature) & readable, F.concat(F.lit(before), _written(kind), F.lit(after)))
    return out


def _plain() -> Column:
    return F.concat(F.col("feature"), F.lit(": "), F.coalesce(F.col("value"), F.lit("None")))


def talking_point(df: DataFrame, templates: dict | None = None) -> DataFrame:
    """One sentence per contribution, marked by its strength."""
    encoded = F.col("feature").rlike("^(encoded_feature_.*|feature_[0-9]+)$")
    factor = F.concat(
        F.lit("Model factor (impact: "), F.format_string("%.3f", "contribution"),
        F.lit(", value: "), F.coalesce(F.col("value"), F.lit("None")), F.lit(")"))
    text = F.when(encoded, factor).otherwise(F.coalesce(base_text(templates), _plain()))
    return df.withColumn("talking_point", F.concat_ws(" ", plus_marks(), text))


def _holds(condition) -> Column:
    if condition is None:
        return F.lit(True)
    kind, limit = condition
    if kind == ">":
        return F.coalesce(F.col("value").try_cast("double") > limit, F.lit(False))
    if kind == "=":
        return F.coalesce(F.col("value") == limit, F.lit(False))
    return F.coalesce(F.col("value").contains(limit), F.lit(False))


def advice(advice_rules: dict | None = None) -> Column:
    """`` (context) → action`` of the first rule that fits the value, null without rules. Rules of a
    feature's own name come first, then those of the longest name it continues after an underscore, so that an
    encoded or suffixed feature keeps the advice of its base."""
    rules_of = advice_rules or ADVICE
    out = F.when(F.lit(False), F.lit(""))
    for own in (True, False):
        for feature in sorted(rules_of, key=len, reverse=True):
            named = F.col("feature") == feature if own else F.col("feature").startswith(f"{feature}_")
            for condition, context, action in rules_of[feature]:
                out = out.when(named & _holds(condition), f" ({context}) → {action}")
    return out


def talking_point_ext(df: DataFrame, templates: dict | None = None, advice_rules: dict | None = None) -> DataFrame:
    """Sentence with context and action; features without rules fall back to name and value."""
    tail = advice(advice_rules)
    full = F.concat(F.coalesce(base_text(templates), _plain()), tail)
    fallback = F.concat(_plain(), F.lit(" (impact: "), signed("contribution", 3), F.lit(")"))
    return df.withColumn("enhanced_talking_point", F.concat_ws(" ", impact_marks(), F.coalesce(full, fallback)))


def talking_points_wide(df: DataFrame, text: str = "talking_point", n: int = 5) -> DataFrame:
    """Texts of a client and product as columns 1..n in rank order, null texts skipped."""
    kept = df.filter(F.col(text).isNotNull())
    texts = F.sort_array(F.collect_list(F.struct("rank", text)))[text]
    return kept.groupBy(*CLIENT_PRODUCT).agg(texts.alias("_t")).select(
        *CLIENT_PRODUCT, *[F.get("_t", i).alias(f"{text}_{i + 1}") for i in range(n)])


def display_value(df: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Human-readable value by the kind of feature; ``*_idx`` values are decoded through
    ``mapping`` (column, code, value)."""
    number, name = F.col("value").try_cast("double"), F.col("feature")
    text = (
        F.when(number.isNull(), F.col("value"))
        .when(name.contains("ratio") | name.contains("allocation"), percent(number))
        .when(name.contains("age") | name.contains("years"), F.format_string("%.1f", number))
        .when(name.contains("amt") | name.contains("assets") | name.contains("mix"), money(number))
        .otherwise(F.format_number(number, 2))
    )
    if mapping is None:
        return df.withColumn("display_value", text)
    names = mapping.select(
        F.concat("column", F.lit("_idx")).alias("feature"), F.col("code").alias("_code"), F.col("value").alias("_name"))
    coded = df.withColumn("_code", F.when(name.endswith("_idx"), number.cast("int")))
    return coded.join(names, ["feature", "_code"], "left").withColumn(
        "display_value", F.coalesce(F.col("_name"), F.when(name.endswith("_idx"), F.col("value")).otherwise(text))
    ).drop("_code", "_name")


def alternatives(probabilities: DataFrame, key: str = "party_id", n: int = 3) -> DataFrame:
    """The next ``n`` classes after the predicted one with the gap to it (classes are few)."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("minus"), F.col("class").alias("class"))))
    lists = probabilities.groupBy(key).agg(ordered.alias("o"))
    rest = lists.select(key, F.get("o", 0).alias("top"), F.posexplode(F.slice("o", 2, n)).alias("i", "alt"))
    return rest.select(
        key, F.col("top.class").alias("predicted"), (F.col("i") + 1).alias("place"), F.col("alt.class").alias("alternative"),
        (-F.col("alt.minus")).alias("probability"), (F.col("alt.minus") - F.col("top.minus")).alias("gap"))


def alternative_reasons(contributions: DataFrame, chosen: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` features whose contribution differs most between the predicted product and the
    first alternative, with the value the client has there (a feature has one for all products).
    ``chosen`` has party_id, predicted and alternative."""
    shown = F.max("display_value" if "display_value" in contributions.columns else "value")
    joined = contributions.join(chosen.select("party_id", "predicted", "alternative"), "party_id")
    sides = joined.groupBy("party_id", "predicted", "alternative", "feature").agg(
        F.max(F.when(F.col("product") == F.col("predicted"), F.col("contribution"))).alias("_p"),
        F.max(F.when(F.col("product") == F.col("alternative"), F.col("contribution"))).alias("_a"), shown.alias("display_value"),
    ).filter(F.col("_p").isNotNull() & F.col("_a").isNotNull())
    diff = sides.withColumn("contribution_diff", F.col("_a") - F.col("_p")).drop("_a", "_p")
    order = [F.round(F.abs("contribution_diff"), 9).desc(), F.col("feature").asc()]
    return first_by(diff, ["party_id"], order, n, rank="rank")


def reasoning_text(signed_rows: DataFrame, predictions: DataFrame, alternative_rows: DataFrame,
                   differences: DataFrame | None = None) -> DataFrame:
    """Why the product, how sure, why not the others, and what tells the first of them apart, as
    lines of text. ``differences`` comes from ``alternative_reasons``.

    ``signed_rows`` comes from ``signed_contributions`` with a ``display_value``,
    ``predictions`` has party_id, predicted_product and pred_prob.
    """
    strength = F.when(F.abs("contribution") > IMPACT_HIGH, "🔥 High").when(
        F.abs("contribution") > IMPACT_MEDIUM, "⭐ Moderate").otherwise("📊 Low")
    name = F.concat(F.col("rank").cast("string"), F.lit(". **"), F.col("feature"), F.lit("** = "), F.col("display_value"))
    for_line = F.concat(name, F.lit(" ("), strength, F.lit(" impact: +"), F.format_string("%.4f", "contribution"), F.lit(")"))
    against_line = F.concat(name, F.lit(" (reducing confidence: "), F.format_string("%.4f", "contribution"), F.lit(")"))

    def lines(side: str, line: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct(F.col("rank"), line.alias("line")))))["line"]

    reasons = signed_rows.groupBy("party_id").agg(
        lines("positive", for_line).alias("_for"), lines("negative", against_line).alias("_against"))
    alt_line = F.concat(
        F.lit("- **"), F.col("alternative"), F.lit("**: "), percent("probability"),
        F.lit(" probability (gap: "), percent("gap"), F.lit(")"))
    others = alternative_rows.groupBy("party_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("place"), alt_line.alias("line"))))["line"].alias("_others"))
    p, product = F.col("pred_prob"), F.col("predicted_product")
    sureness = (
        F.when(p >= 0.7, F.concat(F.lit("**High Confidence ("), percent(p), F.lit(")**: Strong feature alignment with "), product, F.lit(" patterns.")))
        .when(p >= 0.5, F.concat(F.lit("**Moderate Confidence ("), percent(p), F.lit(")**: Reasonable alignment, but some uncertainty remains.")))
        .otherwise(F.concat(F.lit("**Low Confidence ("), percent(p), F.lit(")**: Weak feature alignment; consider reviewing alternative products.")))
    )
    joined = predictions.join(reasons, "party_id", "left").join(others, "party_id", "left")
    apart = F.lit(None).cast("string")
    if differences is not None:
        line = F.concat(F.lit("- **"), F.col("feature"), F.lit("** = "), F.coalesce("display_value", F.lit("None")),
                        F.lit(" (contribution difference: "), signed("contribution_diff", 4), F.lit(")"))
        listed = differences.groupBy("party_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))["line"].alias("_apart"))
        joined = joined.join(listed, "party_id", "left")
        apart = F.when(F.size("_apart") > 0, F.concat_ws("\n", F.lit("\n**Key Differences from Top Alternative:**"), F.col("_apart")))
    against = F.when(F.size("_against") > 0, F.concat_ws("\n", F.lit("\n**Features Reducing Confidence:**"), F.col("_against")))
    text = F.concat_ws(
        "\n",
        F.lit("## Why This Product Was Recommended"),
        F.concat(F.lit("The model predicts **"), product, F.lit("** with "), percent(p), F.lit(" confidence.")),
        F.lit("\n**Top Contributing Features (Supporting Prediction):**"), F.col("_for"), against,
        F.lit("\n## Confidence Score Analysis"), sureness,
        F.lit("\n## Why Other Products Were Not Predicted"), F.lit("**Top Alternative Products:**"), F.col("_others"), apart,
    )
    return joined.select("party_id", "predicted_product", "pred_prob", text.alias("reasoning_text"))


def _matched(names: dict[str, list[str]]) -> Column:
    """Names of the groups that have a member inside the feature's name."""
    hits = [
        F.when(F.greatest(*[F.col("feature").contains(m).cast("int") for m in [*members, members[0]]]) == 1, F.lit(g))
        for g, members in names.items()
    ]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def category_importance(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean importance of the features of each group."""
    by = by if by is not None else ["product"]
    means = contribution_importance(df, by).drop("rank")
    grouped = means.withColumn("category", F.explode(_matched(FEATURE_CATEGORIES)))
    return grouped.groupBy(*by, "category").agg(F.avg("importance").alias("importance"), F.count(F.lit(1)).alias("features"))


def top3_share(df: DataFrame, k: int = 3) -> DataFrame:
    """Share of clients that have the feature among their ``k`` strongest, per product."""
    clients = df.select(*CLIENT_PRODUCT).distinct().groupBy("product").agg(F.count(F.lit(1)).alias("clients"))
    hits = top_contributions(df, k).groupBy("product", "feature").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(clients, "product").withColumn("share", F.col("hits") / F.col("clients"))


def consistency(df: DataFrame) -> DataFrame:
    """Mean variance of the contributions per product, and what it says."""
    variances = df.groupBy("product", "feature").agg(F.var_pop("contribution").alias("v"))
    v = F.col("avg_variance")
    label = F.when(v < VERY_CONSISTENT, "Very Consistent").when(v < MODERATELY_CONSISTENT, "Moderately Consistent").otherwise("Diverse")
    return variances.groupBy("product").agg(F.avg("v").alias("avg_variance")).withColumn("consistency", label)


def pair_importance(df: DataFrame, n: int = 5) -> DataFrame:
    """Summed importance of named feature pairs that both occur, the ``n`` strongest per product."""
    means = contribution_importance(df, ["product"]).drop("rank")
    sides = {f"{i}:{side}": [name] for i, pair in enumerate(FEATURE_PAIRS) for side, name in zip("ab", pair)}
    matched = means.withColumn("_side", F.explode(_matched(sides)))
    per_side = matched.groupBy("product", "_side").agg(F.avg("importance").alias("v"))
    pair = F.split("_side", ":")[0].cast("int")
    both = per_side.groupBy("product", pair.alias("pair_no")).agg(
        F.sum("v").alias("importance"), F.count(F.lit(1)).alias("_sides")).filter("_sides = 2")
    names = F.array(*[F.lit(f"{a} + {b}") for a, b, _ in FEATURE_PAIRS])
    insights = F.array(*[F.lit(t) for _, _, t in FEATURE_PAIRS])
    v = F.col("importance")
    level = F.when(v > PAIR_CRITICAL, "CRITICAL").when(v > PAIR_HIGH, "HIGH").otherwise("MODERATE")
    out = both.select(
        "product", "pair_no", F.get(names, "pair_no").alias("pair"), F.get(insights, "pair_no").alias("insight"),
        "importance", level.alias("level"))
    order = [F.round("importance", 9).desc(), F.col("pair_no").asc()]
    return first_by(out, ["product"], order, n, rank="rank")


def to_base_feature(df: DataFrame, bases: list[str]) -> DataFrame:
    """Contributions of one-hot columns summed per base feature; the category becomes the value."""
    ordered = sorted(bases, key=len, reverse=True)
    name = F.col("feature")
    base = F.when(name.isin(bases), name)
    for b in ordered:
        base = base.when(name.startswith(f"{b}_"), b)
    tagged = df.withColumn("_base", base.otherwise(name))
    category = F.when(F.col("_base") != name, F.expr("substring(feature, length(_base) + 2)"))
    active = F.when(category.isNotNull() & (F.col("value").try_cast("double") == 1), category)
    return tagged.groupBy(*CLIENT_PRODUCT, F.col("_base").alias("feature")).agg(
        F.sum("contribution").alias("contribution"),
        F.coalesce(F.max(active), F.max(F.when(category.isNull(), F.col("value")))).alias("value"))


def explanations(top: DataFrame, scores_long: DataFrame, month: int) -> DataFrame:
    """Explanation table: per client and product the score and arrays of the top features,
    their contributions and values, and talking points."""
    item = F.struct("rank", "feature", "contribution", "value", "talking_point")
    lists = top.groupBy(*CLIENT_PRODUCT).agg(F.sort_array(F.collect_list(item)).alias("i"))
    return lists.join(scores_long.hint("merge"), CLIENT_PRODUCT).select(
        *CLIENT_PRODUCT, "score", F.col("i.feature").alias("top_features"),
        F.col("i.contribution").alias("top_contributions"), F.col("i.value").alias("top_feature_values"),
        F.col("i.talking_point").alias("talking_points"), F.lit(month).alias("prediction_month"))


def narrative(predictions: DataFrame, signed_rows: DataFrame, id_names: dict[int, str]) -> DataFrame:
    """Text for the client: opening, reasons by kind of feature, considerations, next step.

    ``predictions`` has party_id, predicted_product, pred_prob, psn_age and client_tenure;
    ``signed_rows`` are the signed contributions of the predicted product.
    """
    rows = signed_rows.join(
        predictions.select("party_id", "predicted_product", "psn_age", "client_tenure").hint("merge"), "party_id")
    feature, product = F.col("feature"), F.col("predicted_product")
    number = F.col("value").try_cast("double")

    def named(code: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for i, n in id_names.items():
            out = out.when(code == i, n)
        return out.otherwise(F.concat(F.lit("Product "), code.cast("string")))

    def sentence(*parts) -> Column:
        return F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "),
                        *[F.lit(p) if isinstance(p, str) else p for p in parts])

    held = named(number.cast("int"))
    counted = named(F.regexp_extract(feature, "^freq_(\\d+)", 1).try_cast("int"))
    age = F.when(number > 0, number.cast("int")).otherwise(F.col("psn_age"))
    years = F.when(number > 0, number).otherwise(F.col("client_tenure"))
    lower = F.lower(feature)
    # ---- fixed values: sentences of the narrative ----
    reason = (
        F.when(feature.startswith("hist_"), F.when(number > 0, sentence(
            "Your recent purchase of ", held, " indicates strong alignment with ", product, ".")))
        .when(feature == "last_1", F.when(number > 0, sentence(
            "Your most recent product (", held, ") shows a natural progression to ", product, ".")))
        .when(feature == "last_2", F.when(number > 0, sentence(
            "Your purchase history including ", held, " suggests ", product, " would complement your portfolio.")))
        .when(feature.startswith("freq_"), F.when(number > 0, sentence(
            "Your frequent engagement with ", counted, " indicates readiness for ", product, ".")))
        .when(feature == "psn_age", F.when(age.isNotNull(), sentence(
            "At age ", age.cast("string"), ", ", product, " aligns well with your life stage and financial planning needs."))
            .otherwise(sentence("Your age profile indicates ", product, " would be an excellent fit for your financial goals.")))
        .when(lower.contains("tenure"), F.when(years.isNotNull(), sentence(
            "With ", F.format_string("%.1f", years), " years as our client, ", product,
            " represents a natural next step in your relationship with us."))
            .otherwise(sentence("As a valued client, ", product, " represents a natural next step in your relationship with us.")))
        .when(lower.contains("aum") | lower.contains("asset"), sentence(
            "Your asset profile indicates ", product, " would be an excellent fit for your portfolio."))
        .when(lower.contains("channel"), sentence("Clients in your channel typically benefit from ", product, "."))
        .otherwise(sentence("Your ", F.replace(feature, F.lit("_"), F.lit(" ")), " profile strongly supports ", product, "."))
    )
    concern = F.when(F.col("contribution") < -IMPACT_HIGH, (
        F.when(lower.contains("age"), F.concat(
            F.lit("  - While age is a factor, "), product, F.lit(" still offers significant value for your situation.")))
        .when(lower.contains("freq"), F.concat(
            F.lit("  - Even with limited prior engagement in this category, "), product, F.lit(" presents a strong opportunity.")))
    ))
    opening = F.concat(
        F.lit("Based on your client profile and purchase history, we recommend "), product,
        F.lit(" with "), percent("pred_prob"), F.lit(" confidence."))
    closing = F.concat(
        F.lit("\nNext Steps: Let's schedule a consultation to discuss how "), product,
        F.lit(" can help you achieve your financial goals."))
    reasons_title, concerns_title = "\nKey reasons for this recommendation:", "\nConsiderations:"
    # ---- end of fixed values ----

    def in_order(side: str, text: Column, first: int | None = None) -> Column:
        wanted = (F.col("side") == side) & text.isNotNull()
        if first:
            wanted &= F.col("rank") <= first
        return F.sort_array(F.collect_list(F.when(wanted, F.struct(F.col("rank"), text.alias("t")))))["t"]

    lists = rows.groupBy("party_id").agg(
        in_order("positive", reason).alias("_reasons"), in_order("negative", concern).alias("_concerns"),
        in_order("positive", feature, 3).alias("_for"), in_order("negative", feature, 2).alias("_against"))
    joined = predictions.join(lists.hint("merge"), "party_id", "left")
    return joined.select(
        "party_id", "predicted_product", percent("pred_prob").alias("confidence"),
        F.concat_ws(
            "\n", opening,
            F.when(F.size("_for") > 0, F.lit(reasons_title)), F.col("_reasons"),
            F.when(F.size("_against") > 0, F.lit(concerns_title)), F.col("_concerns"), closing,
        ).alias("talking_points"),
        F.array_join("_for", ", ").alias("top_positive_features"),
        F.array_join("_against", ", ").alias("top_negative_features"))
