"""All registered queries."""

from workload import (  # noqa: F401 - importing registers
    aggregations, classification, cleaning, evaluation, explanations, feature_sets, joins,
    monitoring, ordering, preparation, scoring, sequences, sinks, sources,
)
from workload.registry import REGISTRY  # noqa: F401
