"""Named queries over the given tables."""

from importlib import import_module

FAMILIES = [
    "scalar_queries", "source_queries", "timetable_queries", "join_queries", "metric_queries",
    "live_queries", "feature_queries", "stateful_queries",
    "model_queries",
]


def load():
    """``(queries, oracle SQL)`` of every family."""
    from fleetlag.catalog import registry
    from fleetlag.session import ship_code

    ship_code()
    for family in FAMILIES:
        import_module(f"fleetlag.catalog.{family}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
