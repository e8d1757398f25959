"""The named queries, what each covers and its SQL counterpart."""

from collections.abc import Callable
from functools import wraps

from fleetlag.catalog.fleetday import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def _in_utc(fn):
    """Times are UTC everywhere, whatever zone the session came with."""

    @wraps(fn)
    def run(spark, sf):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)

    return run


def query(covers: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under its own name."""

    def add(fn):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = _in_utc(fn)
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return add
