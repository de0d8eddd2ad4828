"""All queries of this subpackage; importing it fills the registry."""

from __future__ import annotations

from keelson.llm import chat_queries, divergence_queries, jaccard_queries, lattice_queries, negatives_queries, packing_queries, quality_queries, secret_queries, substring_queries, topk_queries, toxicity_queries, viterbi_queries  # noqa: F401
from keelson.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
