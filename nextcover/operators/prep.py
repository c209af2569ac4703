"""Model preparation: fitted values are small frames, fitted on the training rows and applied
to any rows. Nothing is collected."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nextcover.functions.columns import correlation
from nextcover.operators.ordered import with_order
from nextcover.operators.quantiles import column_quantiles, with_fitted

# ---- fixed values ----
DOMAIN_GROUPS = {
    "wealth_indicators": ["acct_val_amt", "aum_segment", "wc_total_assets", "wc_net_worth", "household_aum"],
    "risk_profile": ["wc_assetmix_stocks", "wc_assetmix_bonds", "wc_assetmix_mutual_funds",
                     "aggressive_investor", "conservative_investor"],
    "demographics": ["client_age", "client_tenure_years", "channel", "zip_code_income_median"],
    "product_holdings": ["face_amt", "monthly_premium_amount", "cash_val_amt", "product_category", "product_count"],
    "behavioral": ["has_recent_transaction", "transaction_frequency", "policy_changes",
                   "contact_frequency", "digital_engagement"],
    "market_timing": ["snp_close_lead_6", "snp_close_lead_12", "snp_close_variation"],
    "life_stage": ["retirement_planning_trigger", "wealth_building_trigger", "family_protection_trigger"],
    "affinity": ["advisor_investment_affinity", "branch_retirement_affinity"],
    "interactions": ["wealth_risk_score", "age_investment_fit", "relationship_strength", "wealth_concentration"],
}
MUST_HAVE = {
    "investment": ["acct_val_amt", "aum_segment", "wc_assetmix_stocks", "client_age", "channel", "wealth_risk_score"],
    "retirement": ["client_age", "acct_val_amt", "wc_assetmix_bonds", "retirement_planning_trigger", "channel"],
    "life_insurance": ["client_age", "face_amt", "monthly_premium_amount", "family_protection_trigger"],
    "network": ["acct_val_amt", "aum_segment", "channel", "client_tenure_years"],
}
CORRELATION_WEIGHT, DOMAIN_WEIGHT, CORRELATION_FLOOR = 0.7, 0.3, 0.01
WEIGHT_FLOOR, WEIGHT_CAP = 0.5, 10.0
RARE_SHARE, RAISED_SHARE = 0.10, 0.15
# ---- end of fixed values ----


def apply_fill(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Replace nulls by the fitted value of the column."""
    filled = {c: F.expr(f"coalesce({c}, _fit.{c})") for c in fitted.columns}
    return with_fitted(df, fitted).withColumns(filled).drop("_fit")


def fit_medians(train: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row of medians, zero for a column without values."""
    medians = column_quantiles(train, columns, [0.5], exact)
    return medians.agg(*[
        F.coalesce(F.max(F.when(F.col("column") == c, F.col("q")[0])), F.lit(0.0)).alias(c) for c in columns
    ])


def fit_modes(train: DataFrame, columns: list[str], fallback: str = "UNKNOWN") -> DataFrame:
    """One row of modes in one pass; nulls count, and a null mode becomes the fallback."""
    long = train.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("v")))["v"].alias("mode")
    )
    return best.agg(*[
        F.coalesce(F.max(F.when(F.col("column") == c, F.col("mode"))), F.lit(fallback)).alias(c) for c in columns
    ])


def numeric_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Numeric columns, decimals included."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (exclude or [])]


def fill_zero(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=numeric_columns(df, exclude))


def fill_constant(df: DataFrame, columns: list[str], value: str = "Missing") -> DataFrame:
    return df.fillna(value, subset=columns)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))


def fit_encoder(train: DataFrame, columns: list[str]) -> DataFrame:
    """Ordinal codes from 0 in sorted order as (column, value, code), null read as UNKNOWN."""
    values = train.select(*[_text(c).alias(c) for c in columns]).unpivot([], columns, "column", "value").distinct()
    coded = with_order(values, "column", ["value"], number="code", floor=100_000)
    return coded.select("column", "value", (F.col("code") - 1).cast("int").alias("code"))


def encode(df: DataFrame, encoder: DataFrame, columns: list[str], unknown: int = -1, suffix: str = "_idx") -> DataFrame:
    """Attach the code of each column's value; values not seen in training get ``unknown``.

    Spark broadcasts each column's codes when they turn out small enough in bytes.
    """
    for c in columns:
        codes = encoder.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = (
            df.withColumn("_value", _text(c)).join(codes, "_value", "left")
            .withColumn(f"{c}{suffix}", F.coalesce(F.col("_code"), F.lit(unknown))).drop("_value", "_code")
        )
    return df


def label_index(train: DataFrame, label: str) -> DataFrame:
    """Labels with 0-based codes in sorted order."""
    return fit_encoder(train.filter(F.col(label).isNotNull()), [label]).select(F.col("value").alias(label), F.col("code").alias("label"))


def string_index(columns: list[str], label: str) -> tuple[Pipeline, callable]:
    """Frequency-ordered indexers that keep unseen values, and a factory for the way back."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in columns]
    stages.append(StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"))

    def back(labels: list[str]) -> IndexToString:
        return IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels)

    return Pipeline(stages=stages), back


def assemble(columns: list[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep")


def client_clusters(train: DataFrame, val: DataFrame, columns: list[str], k: int = 8, seed: int = 42):
    """Cluster number per row: median fill, standardise and k-means, all fitted on train."""
    filled = [f"_{c}" for c in columns]
    pipeline = Pipeline(stages=[
        Imputer(strategy="median", inputCols=columns, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        KMeans(featuresCol="_scaled", predictionCol="client_cluster", k=k, seed=seed),
    ])
    fitted = pipeline.fit(train)
    scratch = [*filled, "_raw", "_scaled"]
    return fitted.transform(train).drop(*scratch), fitted.transform(val).drop(*scratch)


def target_encode(train: DataFrame, val: DataFrame, columns: list[str], label: str, classes: list[str],
                  smoothing: float = 50.0, fold: Column | None = None, folds: int = 5):
    """Smoothed share of every class per value, ``te_<column>_<class>``.

    A training row is encoded from the other folds: the statistics of its fold are subtracted
    from those of its value, so two small aggregates serve all folds. Validation rows use the
    full statistics. Values without other rows get the global share.
    """
    train = train.filter(F.col(label).isNotNull())
    train = train.withColumn("_fold", fold if fold is not None else F.pmod(F.xxhash64(*train.columns), F.lit(folds)))
    hits = {c: F.sum((F.col(label) == c).cast("long")) for c in classes}
    overall = train.agg(*[F.avg((F.col(label) == c).cast("double")).alias(f"c{i}") for i, c in enumerate(classes)])
    train, val = with_fitted(train, overall), with_fitted(val, overall)
    for column in columns:
        per_fold = train.filter(F.col(column).isNotNull()).groupBy(column, "_fold").agg(
            F.count(F.lit(1)).alias("_n"), *[h.alias(f"_h{i}") for i, h in enumerate(hits.values())])
        sums = ["_n", *[f"_h{i}" for i in range(len(classes))]]
        full = per_fold.groupBy(column).agg(*[F.sum(s).alias(f"_all{s}") for s in sums])
        others = per_fold.join(full, column).select(
            column, "_fold", *[(F.col(f"_all{s}") - F.col(s)).alias(s) for s in sums])
        everyone = full.select(column, *[F.col(f"_all{s}").alias(s) for s in sums])

        def encoded(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
            shares = {
                f"te_{column}_{c}": F.expr(
                    f"(coalesce(_h{i}, 0) + _fit.c{i} * {float(smoothing)!r}D) / (coalesce(_n, 0) + {float(smoothing)!r}D)")
                for i, c in enumerate(classes)
            }
            return df.join(stats, keys, "left").withColumns(shares).drop(*sums)

        train = encoded(train, others, [column, "_fold"])
        val = encoded(val, everyone, [column])
    return train.drop("_fold", "_fit"), val.drop("_fit")


def class_weights(df: DataFrame, label: str, kind: str = "balanced") -> DataFrame:
    """Weight per class: ``balanced`` n/(k*n_c), ``sqrt_cap`` its root within limits,
    ``sqrt_mean`` its root scaled back to the mean weight."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # one row per class from here on
    everything = Window.partitionBy(F.lit(1))
    classes = F.count(F.lit(1)).over(everything)
    balanced = counts.withColumn("weight", F.sum("n").over(everything) / (classes * F.col("n")))
    if kind == "balanced":
        return balanced
    if kind == "sqrt_cap":
        return balanced.withColumn(
            "weight", F.least(F.greatest(F.sqrt("weight"), F.lit(WEIGHT_FLOOR)), F.lit(WEIGHT_CAP)))
    if kind == "sqrt_mean":
        scale = F.avg("weight").over(everything) / F.avg(F.sqrt("weight")).over(everything)
        return balanced.withColumn("weight", F.sqrt("weight") * scale)
    raise ValueError(f"unknown kind of weight: {kind}")


def with_weight(df: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    """Rows with their class weight. There is one row per class (seven categories at most),
    which bounds the broadcast."""
    return df.join(F.broadcast(weights.select(label, "weight")), label)


def stable_fraction(*keys: str, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the key only, so splits survive re-runs and losses."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) / 1_000_000


def split(df: DataFrame, fractions: dict[str, float], position: Column) -> DataFrame:
    """Name the part of each row in ``split``, by its position in [0, 1)."""
    out, edge = None, 0.0
    for name, share in fractions.items():
        edge += share
        hit = position < F.lit(round(edge, 9))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return df.withColumn("split", out.otherwise(list(fractions)[-1]))


def split_stratified(df: DataFrame, label: str, train_share: float = 0.8, order: list[str] | None = None,
                     key: list[str] | None = None) -> DataFrame:
    """The same share of every class in train, exact to a row.

    Rows are ranked inside their class in hash order (or ``order``); big classes are ranked in
    slices of that order, so no class is ever sorted by one task.
    """
    if order is None:
        df = df.withColumn("_hash", F.xxhash64(*key))
        order = ["_hash", *key]
    ranked = with_order(df, label, order, number="_rank")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    part = F.when((F.col("_rank") - 1) / F.col("_size") < train_share, "train").otherwise("validation")
    return ranked.join(F.broadcast(sizes), label).withColumn("split", part).drop("_rank", "_size", "_hash")


def sample_capped(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """About ``n`` rows, all of them when there are fewer; the same rows on every run."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.filter(stable_fraction(*key, seed=seed) < F.lit(float(n)) / F.greatest(total, F.lit(1)))


def oversample(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Repeat rows of classes below a tenth of the largest until they reach 15 % of it.

    ``copy_no`` is 1 for the original. Copies are spread as evenly as the target allows.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).scalar()
    rare = counts.filter(F.col("_n") < largest * RARE_SHARE).withColumn("_target", F.floor(largest * RAISED_SHARE))
    # one row per rare class, seven categories at most
    tagged = df.join(F.broadcast(rare), label, "left")
    frequent = tagged.filter(F.col("_target").isNull()).withColumn("copy_no", F.lit(1))
    ranked = with_order(tagged.filter(F.col("_target").isNotNull()), label, order, number="_rank")
    extra = (F.col("_rank") <= F.col("_target") % F.col("_n")).cast("int")
    copies = (F.floor(F.col("_target") / F.col("_n")) + extra).cast("int")
    repeated = ranked.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))))
    return frequent.drop("_n", "_target").unionByName(repeated.drop("_n", "_target", "_rank"))


def interpolate_minority(df: DataFrame, label: str, features: list[str], key: list[str], projections: int = 3,
                         seed: int = 42) -> DataFrame:
    """New rows for classes below a tenth of the largest, as many as bring them to 15 % of it.

    A new row lies between a row of the class and its nearest one among the rows beside it in
    ``projections`` random directions (each the class's rows in order of a weighted sum of their
    standardised features, ties by ``key``, which must be unique), at a place that the key and the
    copy's number decide. So neighbours cost an ordering, not pairs, and a big class is no task.
    Rows with a missing feature take no part; a class's only row is its own neighbour.

    Returns the label, the key, ``copy_no`` from 1, ``neighbour_`` and the key for the other row,
    ``weight`` (0 at the row, 1 at the neighbour) and the features.
    """
    known = df.select(label, *key, *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).scalar()
    rare = counts.filter(F.col("_n") < largest * RARE_SHARE).withColumn("_more", F.floor(largest * RAISED_SHARE) - F.col("_n"))
    rows = known.join(rare.filter("_more > 0"), label)
    spread = known.agg(*[F.coalesce(F.nullif(F.stddev_samp(f), F.lit(0.0)), F.lit(1.0)).alias(f) for f in features])
    draw = random.Random(seed)
    sums = [sum(F.col(f) / F.col(f"_fit.{f}") * draw.gauss(0, 1) for f in features) for _ in range(projections)]
    sides = F.array(*[F.struct(F.lit(i).alias("_side"), s.alias("_place")) for i, s in enumerate(sums)])
    placed = with_fitted(rows, spread).withColumn("_s", F.explode(sides)).withColumns({
        "_line": F.struct(F.col(label), F.col("_s._side")), "_place": F.col("_s._place"), "_self": F.struct(*key, *features)}).drop("_fit", "_s")
    beside = with_order(placed, "_line", ["_place", *key], number="_rank", ahead={"_self": "_next"}, behind={"_self": "_last"})

    def distance(other: Column) -> Column:
        return sum((F.col(f"_self.{f}") - other[f]) * (F.col(f"_self.{f}") - other[f]) for f in features)

    near = F.filter(F.array("_next", "_last"), lambda x: x.isNotNull())
    options = F.transform(near, lambda x: F.struct(distance(x).alias("_d"), x.alias("_other")))
    chosen = (beside.withColumn("_near", F.array_min(options)).groupBy(label, *key)
              .agg(F.first("_self").alias("_self"), F.min("_near").alias("_near"), F.first("_n").alias("_n"), F.first("_more").alias("_more"),
                   F.max(F.when(F.col("_line._side") == 0, F.col("_rank"))).alias("_rank")))
    copies = (F.floor(F.col("_more") / F.col("_n")) + (F.col("_rank") <= F.col("_more") % F.col("_n")).cast("int")).cast("int")
    other = F.coalesce(F.col("_near._other"), F.col("_self"))
    made = chosen.filter(copies > 0).withColumns({"_other": other, "copy_no": F.explode(F.sequence(F.lit(1), copies))})
    made = made.withColumn("weight", stable_fraction(*key, "copy_no", seed=seed))
    return made.select(
        label, *key, "copy_no", *[F.col(f"_other.{k}").alias(f"neighbour_{k}") for k in key], "weight",
        *[(F.col(f"_self.{f}") + F.col("weight") * (F.col(f"_other.{f}") - F.col(f"_self.{f}"))).alias(f) for f in features])


def domain_score(feature: str) -> float:
    return 1.0 if any(f in feature for names in DOMAIN_GROUPS.values() for f in names) else 0.0


def must_have(target: str) -> list[str]:
    return next((names for part, names in MUST_HAVE.items() if part in target), [])


def select_features(df: DataFrame, label: str, candidates: list[str], encoder: DataFrame | None = None,
                    min_features: int = 15, max_features: int = 100) -> DataFrame:
    """Score and choose features: 0.7 |correlation| + 0.3 domain match.

    All correlations come from one aggregate over all rows. The result has one row per
    candidate column; text columns are read through ``encoder`` codes.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name in candidates]
    if text:
        df = encode(df, encoder if encoder is not None else fit_encoder(df, text), text, suffix="_code")
    source = {c: f"{c}_code" if c in text else c for c in candidates}
    row = df.agg(*[correlation(s, label).alias(c) for c, s in source.items()])
    scored = row.unpivot([], candidates, "feature", "corr").withColumns({
        "correlation": F.coalesce(F.abs(F.nanvl(F.col("corr"), F.lit(0.0))), F.lit(0.0)),
        "direction": F.when(F.col("corr") > 0, "positive").otherwise("negative"),
    })
    matching = [c for c in candidates if domain_score(c) > 0]
    wanted = [c for c in must_have(label) if c in candidates]
    scored = scored.withColumn("domain_score", F.col("feature").isin(matching).cast("double")).withColumn(
        "combined_score", F.col("correlation") * CORRELATION_WEIGHT + F.col("domain_score") * DOMAIN_WEIGHT)
    # one row per column of the schema from here on
    order = [F.col("combined_score").desc(), F.col("feature").asc()]
    everything = Window.partitionBy(F.lit(1))
    ranked = scored.withColumn("rank", F.row_number().over(everything.orderBy(*order)))
    relevant = (
        F.col("rank") <= max_features if len(candidates) > max_features
        else (F.col("correlation") > CORRELATION_FLOOR) | (F.col("domain_score") > 0)
    )
    chosen = ranked.withColumn("_chosen", (relevant | F.col("feature").isin(wanted)).cast("int"))
    chosen = chosen.withColumn("_count", F.sum("_chosen").over(everything)).withColumn(
        "_spare", F.row_number().over(Window.partitionBy("_chosen").orderBy(*order)))
    fills = (F.col("_chosen") == 0) & (F.col("_spare") <= min_features - F.col("_count"))
    return chosen.withColumn("selected", ((F.col("_chosen") == 1) | fills).cast("int")).select(
        "feature", "correlation", "direction", "domain_score", "combined_score", "rank", "selected")


def target_balance(df: DataFrame, targets: list[str]) -> DataFrame:
    """Positives per target; a target without both outcomes cannot be trained."""
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.sum(F.col(t).cast("long")).alias(t) for t in targets])
    return row.unpivot(["total"], targets, "target", "positives").withColumns({
        "share": F.col("positives") / F.col("total"),
        "trainable": ((F.col("positives") > 0) & (F.col("positives") < F.col("total"))).cast("int"),
    })


def all_features(metadata: DataFrame) -> DataFrame:
    """Distinct features over the lists of all models."""
    return metadata.select(F.explode("features").alias("feature")).distinct()
