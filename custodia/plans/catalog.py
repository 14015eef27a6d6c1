"""Importing this module registers every query."""

from custodia.plans import (  # noqa: F401
    corpus_queries,
    flow_queries,
    job_queries,
    pii_queries,
    quality_queries,
    rule_queries,
    store_queries,
    stream_queries,
    synth_queries,
)
from custodia.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
