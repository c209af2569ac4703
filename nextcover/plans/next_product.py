"""What clients buy after their first policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.functions.classify import product_category
from nextcover.operators.clean import active, require_values
from nextcover.operators.client360 import join_product_lookup
from nextcover.operators.policies import first_second_pivot, first_two
from nextcover.operators.propensity import top_transitions, transition_probs
from nextcover.sources.readers import latest_month


# what the classification reads
RULE_FIELDS = ["policy_no", "prod_lob", "sub_product_level_1", "sub_product_level_2", "product"]


def first_second(policies: DataFrame, lookup: DataFrame, first: list[str] | None = None,
                 second: list[str] | None = None) -> DataFrame:
    """Newest month's active policies as first and second policy per client, both classified.

    Clients are trimmed to two policies before the only shuffle on the client, and the product
    lookup and the classification see those two policies only. ``first`` and ``second`` name
    the attributes to carry, all by default.
    """
    current = require_values(active(latest_month(policies)), ["party_id", "policy_no", "register_date"])
    pairs = first_second_pivot(join_product_lookup(first_two(current), lookup), first=first, second=second)
    return pairs.withColumns({
        "product_category": product_category(product="product"),
        "second_product_category": product_category(
            "second_prod_lob", "second_sub_product_level_1", "second_sub_product_level_2", "second_product",
            null_when="second_policy_no IS NULL"),
    })


def likely_next_products(policies: DataFrame, lookup: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most likely second products per first product."""
    bought = first_second(policies, lookup, RULE_FIELDS, RULE_FIELDS).filter(F.col("second_product_category").isNotNull())
    return top_transitions(transition_probs(bought), n)
