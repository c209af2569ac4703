"""Projection, cleaning and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nextcover.functions.columns import date_of, finite
from nextcover.functions.classify import SUB_TARGETS, TARGET_CATEGORIES
from nextcover.operators.ordered import first_by, with_totals
from nextcover.schemas import require_columns
from nextcover.sources.readers import clean_name

# ---- fixed values ----
NULL_TOKENS = ["NULL", "null", "Null", ""]
FIRST_POLICY_NAMES = {
    "party_id": "party_id", "policy_no": "policy_no", "register_date": "first_register_date",
    "product_category": "first_product_category", "acct_val_amt": "first_acct_val_amt",
    "face_amt": "first_face_amt", "cash_val_amt": "first_cash_val_amt",
    "wc_total_assets": "wc_total_assets", "psn_age": "psn_age", "client_seg": "client_seg",
    "aum_band": "aum_band", "channel": "channel", "branchoffice_code": "branchoffice_code",
}
LEAK_PREFIXES = ["cross_sell_"]
LEAK_SUFFIXES = ["_lead"]
LEAK_NAMES = ["days_to_cross_sell"]
# ---- end of fixed values ----


def first_policy_view(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for c, n in FIRST_POLICY_NAMES.items()])


def drop_cols(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def leaking_columns(columns: list[str], label_features: list[str] | None = None) -> list[str]:
    """Columns derived from the label or from its date, in input order.

    ``label_features`` names the engineered flags that read the label; the feature module
    knows them (``LABEL_FEATURES``).
    """
    named = {
        *LEAK_NAMES, *SUB_TARGETS, *(label_features or []),
        *[f"{c.lower()}_cross_sell" for c in TARGET_CATEGORIES],
    }
    return [
        c for c in columns
        if c in named
        or any(c.startswith(p) for p in LEAK_PREFIXES)
        or any(c.endswith(s) for s in LEAK_SUFFIXES)
    ]


def exclude_leakage(columns: list[str], label_features: list[str] | None = None) -> list[str]:
    leaking = set(leaking_columns(columns, label_features))
    return [c for c in columns if c not in leaking]


def assert_no_leakage(columns: list[str], label_features: list[str] | None = None) -> None:
    leaking = leaking_columns(columns, label_features)
    if leaking:
        raise ValueError(f"columns derived from the label: {', '.join(leaking)}")


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def resolve_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Select columns by name, ignoring case and underscores; unknown names are left out."""
    def plain(name: str) -> str:
        return name.lower().replace("_", "")

    known = {plain(c): c for c in df.columns}
    return df.select(*[F.col(known[plain(w)]).alias(w) for w in wanted if plain(w) in known])


def compatible(metadata: dict, columns: list[str], classes: list) -> bool:
    """Whether a stored model fits the data: the same number of features and classes."""
    return len(metadata["features"]) == len(columns) and len(metadata["classes"]) == len(classes)


def null_tokens(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(NULL_TOKENS), F.col(c)) for c in columns})


def to_number(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def to_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("date") for c in columns})


def decimals_to_double(df: DataFrame) -> DataFrame:
    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else df


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def dedupe_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, chosen by an explicit order."""
    return first_by(df, keys, order)


def mean_age(df: DataFrame, party: str = "party_id", age: str = "psn_age") -> DataFrame:
    """Replace the age by the client's mean age.

    The mean is aggregated on its own (map-side combine), then joined; a client with very many
    rows is spread over several tasks.
    """
    means = with_totals(df, party, {"_mean_age": F.avg(age)})
    return means.withColumn(age, F.col("_mean_age")).drop("_mean_age")


def finite_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def require_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def valid_events(df: DataFrame, key="party_id", date="register_date", category="product_category") -> DataFrame:
    require_columns(df, [key, date, category])
    return require_values(df, [key, date, category])


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("policy_status") == "Active")


def in_branch(df: DataFrame, code: str) -> DataFrame:
    return df.filter(F.col("branchoffice_code") == code)


def since(df: DataFrame, day, column: str = "register_date") -> DataFrame:
    return df.filter(F.col(column) >= date_of(day))


def in_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def restrict_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a list of clients, as a semi join: the list may be of any size."""
    return df.join(ids.select(key), key, "left_semi")


def valid_targets(df: DataFrame, column: str = "product_category", classes=TARGET_CATEGORIES) -> DataFrame:
    return df.filter(F.col(column).isin(list(classes)))


def complete_period(df: DataFrame) -> DataFrame:
    return require_values(df, ["strt_date", "end_date", "party_id"])


def above(df: DataFrame, column: str, threshold: float, inclusive: bool = False) -> DataFrame:
    return df.filter(F.col(column) >= threshold if inclusive else F.col(column) > threshold)


def union_flagged(train: DataFrame, val: DataFrame, flag_column: str = "is_validation") -> DataFrame:
    return train.withColumn(flag_column, F.lit(False)).unionByName(val.withColumn(flag_column, F.lit(True)))
