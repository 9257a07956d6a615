"""Points as a stream: the plan is fixed beforehand and holds no state, so each batch runs as a table would."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.points import transform_points
from ..plans.catalog import Catalog


def transform_stream(points: DataFrame, catalog: Catalog, source: str, target: str, **options) -> DataFrame:
    """A streaming DataFrame of pid, x, y, z as transform_points() makes it; grids are joined as static tables."""
    if not points.isStreaming:
        raise ValueError("points is no stream")
    return transform_points(points, catalog, source, target, **options)
