"""Imports every query module so the registry is complete."""

from . import q_attribution, q_clean, q_features, q_fusion, q_graph, q_models, q_profile, q_records, q_sampling, q_sources, q_stream, q_text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
