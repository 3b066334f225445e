"""All registered queries."""

from wordloom.plans import (  # noqa: F401
    analysis_workload,
    cleaning_workload,
    corpus_workload,
    lexicon_workload,
    paradigm_workload,
    source_workload,
)
from wordloom.plans.registry import QUERIES

__all__ = ["QUERIES"]
