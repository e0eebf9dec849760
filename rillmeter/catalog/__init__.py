"""Named queries, one or more per operator, each with the SQL that must give the same rows."""

from rillmeter.catalog import (  # noqa: F401  (importing registers)
    aggregates,
    clusters,
    columns,
    demand,
    features,
    joins,
    quality,
    scaling,
    sources,
    statistics,
)
from rillmeter.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
