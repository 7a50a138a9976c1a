"""Queries over the driver tables, grouped by family."""

import importlib

FAMILIES = (
    "q_sequences", "q_evaluation", "q_similarity", "q_grounding", "q_profiles",
    "q_graph", "q_reporting", "q_features", "q_instructions", "q_sources", "q_exports",
)


def load_all() -> None:
    """Import every family once, which registers its queries."""
    for family in FAMILIES:
        importlib.import_module(f"crossloom.plans.{family}")
