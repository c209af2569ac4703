"""Declared input schemas and the check that an input has the columns an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame



ASSET_MIX = [
    "wc_assetmix_stocks", "wc_assetmix_bonds", "wc_assetmix_mutual_funds",
    "wc_assetmix_annuity", "wc_assetmix_deposits", "wc_assetmix_other_assets",
]

POLICY_DDL = (
    "party_id string, policy_no string, source_sys_id string, plan_code string, "
    "plan_subcd_code string, prod_lob string, sub_product_level_1 string, "
    "sub_product_level_2 string, wti_lob_txt string, register_date date, trmn_eff_date date, "
    "strt_date date, end_date date, birth_dt date, isrd_brth_date date, psn_age int, "
    "acct_val_amt double, face_amt double, cash_val_amt double, monthly_premium_amount double, "
    "wc_total_assets double, " + ", ".join(f"{c} double" for c in ASSET_MIX) + ", "
    "client_seg string, client_seg_1 string, aum_band string, channel string, "
    "agent_segment string, agt_no string, agt_class string, branchoffice_code string, "
    "branch_name string, division_name string, business_city string, "
    "business_state_cod string, policy_status string, policy_type string, business_month int"
)
PRODUCT_LOOKUP_DDL = (
    "source_sys_id string, idb_plan_cd string, idb_sub_plan_cd string, stmt_plan_typ_txt string"
)
MARKET_DDL = (
    "snp_business_month string, snp_close_variation double, snp_close_lead_3 double, "
    "snp_close_lead_6 double, snp_close_lead_12 double"
)
SCORES_DDL = (
    "party_id string, investment_score double, retirement_score double, "
    "life_insurance_score double, network_products_score double, prediction_month int"
)
CONTRIBUTIONS_DDL = (
    "party_id string, product string, feature string, contribution double, value string"
)
PREDICTIONS_DDL = (
    "party_id string, first_product_category string, predicted_product string, "
    "pred_prob double, business_month int"
)
MODEL_METADATA_DDL = (
    "product string, training_month int, features array<string>, roc_auc double, "
    "model_path string"
)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself, or an error that names what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
