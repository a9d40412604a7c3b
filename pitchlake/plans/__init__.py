"""Named queries over the tables of a data folder."""

from importlib import import_module

#: Modules that register queries.
MODULES = ("training_data", "projections", "cleaning", "parsing", "edges", "stats", "graph", "text", "questions", "answers", "enrichment", "sources")


def load() -> None:
    """Register the queries of all modules."""
    for name in MODULES:
        import_module(f"pitchlake.plans.{name}")
