"""Text output of points."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(points: DataFrame, path: str, delimiter: str = " ", columns: tuple[str, ...] = ("x", "y", "z", "unc", "region_index")) -> None:
    """A line for each point, without a header, of those columns that there are."""
    points.select(*[c for c in columns if c in points.columns]).write.option("sep", delimiter).option("header", False).mode("errorifexists").csv(path)
