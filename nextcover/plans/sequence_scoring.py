"""Scoring input from product sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.functions.classify import CATEGORIES, classify
from nextcover.operators.clean import active, valid_events
from nextcover.operators.client360 import client_snapshot, join_snapshot
from nextcover.operators.prep import apply_fill, encode, fill_zero
from nextcover.operators.sequences import (
    collapse_repeats, events, history_features, min_length, pad_history, scoring_history, to_ids,
)
from nextcover.sources.readers import up_to_month

# ---- fixed values ----
SNAPSHOT_NUMBERS = ["acct_val_amt", "face_amt", "cash_val_amt", "wc_total_assets", "psn_age"]
SNAPSHOT_TEXTS = ["client_seg", "client_seg_1", "aum_band", "channel", "agent_segment", "branchoffice_code"]
# ---- end of fixed values ----


def sequence_events(policies: DataFrame, vocab: DataFrame, min_events: int = 2) -> DataFrame:
    """Classified events without repeats, as ids, of clients with enough of them."""
    known = valid_events(classify(policies))
    kept = known.select("party_id", "register_date", "policy_no", F.col("product_category").alias("value"))
    return to_ids(min_length(collapse_repeats(kept), min_events), vocab)


def prepare_scoring(policies: DataFrame, vocab: DataFrame, modes: DataFrame, encoder: DataFrame,
                    month: int, max_len: int = 10) -> DataFrame:
    """One row per client: padded history, history features, filled and encoded snapshot.

    ``vocab``, ``modes`` and ``encoder`` are fitted on the training rows.
    """
    scope = active(up_to_month(policies, month))
    history = scoring_history(sequence_events(scope, vocab, 1), max_len)
    snapshot = client_snapshot(valid_events(classify(scope))).select("party_id", *SNAPSHOT_NUMBERS, *SNAPSHOT_TEXTS)
    joined = join_snapshot(history_features(history, len(CATEGORIES)), snapshot)
    filled = fill_zero(apply_fill(joined, modes))
    return encode(pad_history(filled, max_len), encoder, SNAPSHOT_TEXTS).drop("history")
