"""A model of the next product, learnt from sliding examples of product sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextcover.functions.classify import CATEGORIES
from nextcover.operators.models import train_rf
from nextcover.operators.prep import class_weights, with_weight
from nextcover.operators.scoring import decode_predictions
from nextcover.operators.sequences import history_features, history_features_ext, pad_history, scoring_history, sliding_examples

MAX_LEN = 10


def sequence_features(classes: int = len(CATEGORIES), max_len: int = MAX_LEN) -> list[str]:
    return ["seq_len", "last_1", "last_2", "last_3", "unique_prior", "num_switches", *[f"freq_{i}" for i in range(1, classes + 1)],
            "diversity_ratio", "switch_ratio", "most_freq_product", "recency_weight", "transition_pattern", *[f"hist_{i}" for i in range(max_len)]]


def with_sequence_features(histories: DataFrame, classes: int = len(CATEGORIES), max_len: int = MAX_LEN) -> DataFrame:
    return pad_history(history_features_ext(history_features(histories, classes)), max_len)


def fit_sequence_model(numbered: DataFrame, learn: Column, max_len: int = MAX_LEN, **params):
    """A weighted forest over the examples of the clients for which ``learn`` holds.

    ``numbered`` has the clients' changes of product with ids from 1; a label is an id less one.
    Examples are cut by client, so no client's history teaches about itself. They are kept for the
    passes of the fit.
    """
    examples = with_sequence_features(sliding_examples(numbered.filter(learn), max_len), max_len=max_len)
    labelled = examples.withColumn("label", (F.col("label") - 1).cast("double"))
    kept = labelled.select("party_id", "position", "label", *sequence_features(max_len=max_len)).persist()
    model = train_rf(with_weight(kept, class_weights(kept, "label", "sqrt_cap"), "label"), sequence_features(max_len=max_len), weight="weight", **params)
    kept.unpersist()
    return model


def score_sequences(model, numbered: DataFrame, names: list[str], max_len: int = MAX_LEN) -> DataFrame:
    """The next product of every client, from its last ``max_len`` changes: predicted product, its
    probability and one column per product. ``names`` are the products by id."""
    histories = with_sequence_features(scoring_history(numbered, max_len), max_len=max_len)
    n = model.stages[-1].numClasses
    return decode_predictions(model.transform(histories), names[:n]).drop("features", "rawPrediction", "probability", "prediction")
