"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.assoc import connected_components


def connected(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs -> (id, component): the smallest id reachable, for each id with an edge."""
    return connected_components(edges, "u", "v")
