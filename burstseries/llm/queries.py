"""All queries of the subpackage."""

from burstseries.llm import alignment, chaining, max_sketch, mixing, near_dup, packing, pivot_prints, quality, rules, suffix_dedup, suffix_tree, token_counts, topk  # noqa: F401
from burstseries.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
