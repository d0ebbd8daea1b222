"""The query catalogue: every registered query and its DuckDB oracle."""

from . import (  # noqa: F401  (registers)
    analytics_q,
    features_q,
    graph_q,
    metrics_q,
    models_q,
    ontology_q,
    pairs_q,
    qa_q,
    selection_q,
    sources_q,
    stacker_q,
    stratify_q,
    streaming_q,
)
from .common import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
