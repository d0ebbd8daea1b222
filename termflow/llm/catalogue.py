"""All queries of the subpackage and their DuckDB SQL."""

from . import (  # noqa: F401  (registers)
    chat,
    collocations,
    decontaminate,
    forest,
    html,
    licences,
    mixture,
    near_dedup,
    quality,
    shards,
    suffix,
    tokens,
    whiten,
)
from .common import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
