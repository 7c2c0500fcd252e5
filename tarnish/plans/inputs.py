"""Tables that several queries share, prepared once per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnish.model import configurations, corrupted_columns
from tarnish.operators import cover, noise
from tarnish.session import stage
from tarnish.sources import views

CONFIGS = configurations(views.POOL)
LEVEL, SEED = 10, 7
BROKEN = [views.LINE_PART, views.PART_PRICE]  # dependencies that raw line items violate
_versions: dict[tuple, DataFrame] = {}


def corrupted(spark: SparkSession, sf_dir: str, config: str = "C4", level: int = LEVEL, seed: int = SEED) -> DataFrame:
    """Shipments with `level` percent of the rows corrupted in the columns of a configuration."""
    key = (spark.sparkContext.applicationId, sf_dir, config, level, seed)
    if key not in _versions:
        ship = views.shipments(spark, sf_dir)
        _versions[key] = stage(noise.inject_shared(ship, corrupted_columns(CONFIGS[config]), level, seed))
    return _versions[key]


def line_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs, or bounds of them, for every conflict component of the raw line items."""
    key = (spark.sparkContext.applicationId, sf_dir, "repairs")
    if key not in _versions:
        _versions[key] = stage(cover.component_repairs(views.lines(spark, sf_dir), BROKEN))
    return _versions[key]
