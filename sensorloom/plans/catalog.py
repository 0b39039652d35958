"""All registered queries."""

from sensorloom.plans import q_clean, q_context, q_features, q_sampling, q_sequences, q_evaluate, q_quality, q_models  # noqa: F401
from sensorloom.plans.registry import QUERIES  # noqa: F401
