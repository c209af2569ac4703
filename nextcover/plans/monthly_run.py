"""The monthly run: score single-policy clients of a branch, then compare with last month."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.functions.classify import classify
from nextcover.operators.clean import FIRST_POLICY_NAMES, active, first_policy_view, valid_events
from nextcover.operators.features import season
from nextcover.operators.models import train_rf
from nextcover.operators.monitor import prediction_outcome
from nextcover.operators.policies import first_two, single_policy_clients
from nextcover.operators.prep import apply_fill, encode, fit_encoder, fit_medians, fit_modes, label_index
from nextcover.operators.scoring import decode_predictions, final_predictions, run_key, stamp_run
from nextcover.functions.columns import date_of
from nextcover.sources.readers import latest_month
from nextcover.sources.writers import write_run

# ---- fixed values ----
RUN_NUMBERS = ["first_acct_val_amt", "first_face_amt", "first_cash_val_amt", "wc_total_assets"]
RUN_TEXTS = ["first_product_category", "client_seg", "aum_band", "channel"]
# ---- end of fixed values ----


def classified(policies: DataFrame, *more: str) -> DataFrame:
    """What a run reads of its policies, and their category. A run reads all policies four times, and the
    rules of the category are most of that work, so store this once and run on it."""
    wanted = dict.fromkeys([*FIRST_POLICY_NAMES, "policy_status", "business_month", *more])
    return classify(policies).select(*wanted)


def known_events(policies: DataFrame) -> DataFrame:
    """Valid policies with their category: of rows of ``classified`` the one they have."""
    rows = policies if "product_category" in policies.columns else classify(policies)
    return valid_events(rows).select(*FIRST_POLICY_NAMES)


def scoring_population(policies: DataFrame, as_of, branch: str | None = None) -> DataFrame:
    """Single-policy clients of the newest month with the features of their first policy."""
    scope = active(policies if branch is None else policies.filter(F.col("branchoffice_code") == branch))
    single = single_policy_clients(known_events(latest_month(scope)))
    gap = F.datediff(date_of(as_of), F.col("first_register_date")) / 365.25
    return first_policy_view(single).withColumns({
        "years_to_second": gap, "season": season("first_register_date")})


def training_population(policies: DataFrame) -> DataFrame:
    """First policies of clients with a second one, whose category is ``next_product``."""
    two = first_two(known_events(active(latest_month(policies))))
    second = two.filter("_rn = 2").select("party_id", F.col("product_category").alias("next_product"))
    return first_policy_view(two.filter("_rn = 1")).join(second, "party_id")


def model_input(population: DataFrame, medians: DataFrame, modes: DataFrame, encoder: DataFrame) -> DataFrame:
    """Filled and encoded with values fitted on the training rows."""
    return encode(apply_fill(apply_fill(population, medians), modes), encoder, RUN_TEXTS)


def publish(predictions: DataFrame, demographics: DataFrame, month: int, version: str) -> DataFrame:
    """The run's output table with its key."""
    table = stamp_run(final_predictions(predictions, demographics), prediction_month=month, model_version=version)
    return table.withColumn("run_key", run_key("prediction_month"))


@dataclass(frozen=True)
class FittedRun:
    """What a run learns from its training rows: fills, codes, products by label and the model."""

    medians: DataFrame
    modes: DataFrame
    encoder: DataFrame
    products: list[str]
    model: PipelineModel

    def release(self) -> None:
        for kept in (self.medians, self.modes, self.encoder):
            kept.unpersist()


RUN_FEATURES = [*RUN_NUMBERS, *[f"{c}_idx" for c in RUN_TEXTS]]


def fit_run(train: DataFrame, **params) -> FittedRun:
    """Fit fills, codes and a forest on the training population. The list of products, one per
    class, is the only thing that reaches the driver.

    The training rows are kept for the passes of the fit; fills and codes, a few rows each, stay
    until ``release``, so that no plan computes them again.
    """
    train = train.persist()
    medians, modes = fit_medians(train, RUN_NUMBERS).persist(), fit_modes(train, RUN_TEXTS).persist()
    encoder = fit_encoder(apply_fill(train, modes), RUN_TEXTS).persist()
    products = [r["next_product"] for r in label_index(train, "next_product").orderBy("label").collect()]
    label = F.array_position(F.array(*map(F.lit, products)), F.col("next_product")) - 1
    rows = model_input(train, medians, modes, encoder).withColumn("label", label.cast("double")).select("label", *RUN_FEATURES).persist()
    model = train_rf(rows, RUN_FEATURES, **params)
    for kept in (rows, train):
        kept.unpersist()
    return FittedRun(medians, modes, encoder, products, model)


def predict_run(population: DataFrame, fitted: FittedRun) -> DataFrame:
    scored = fitted.model.transform(model_input(population, fitted.medians, fitted.modes, fitted.encoder))
    out = decode_predictions(scored, fitted.products[:fitted.model.stages[-1].numClasses])
    return out.select("party_id", "first_product_category", "predicted_product", "pred_prob")


def run_month(policies: DataFrame, demographics: DataFrame, table: str, month: int, as_of, version: str = "1",
              branch: str | None = None, **params) -> None:
    """The month's run from policies to the stored table of predictions: fit on clients with a second
    policy, score those with one, publish. Running it again replaces the month. Takes policies, or the
    rows of ``classified``."""
    fitted = fit_run(training_population(policies), **params)
    predictions = predict_run(scoring_population(policies, as_of, branch), fitted)
    published = publish(predictions, demographics, month, version)
    write_run(published, table, "business_month", month, ["party_id"], [F.col("pred_prob").desc(), F.col("predicted_product")])
    fitted.release()


def run_outcome(published: DataFrame, policies: DataFrame, month: int) -> DataFrame:
    """What clients bought whom the month before's run had predictions for."""
    return prediction_outcome(published.select("party_id", "first_product_category", "predicted_product", "business_month"), classify(policies), month)
