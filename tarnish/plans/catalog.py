"""All registered queries and the flagship plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnish.model import redundancy_dependencies
from tarnish.operators import incons, profile
from tarnish.plans import conflict_queries, evaluate_queries, inputs, noise_queries, prepare_queries, relational_queries, result_queries  # noqa: F401
from tarnish.plans.registry import ORACLES, QUERIES, exact_text
from tarnish.sources import views


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certify the dependencies on clean data, then measure the corrupted table."""
    clean = views.shipments(spark, sf_dir)
    profile.require_certified(profile.certify(clean, [*views.POOL, *redundancy_dependencies(views.POOL)]))
    return exact_text(incons.indices(inputs.corrupted(spark, sf_dir), views.POOL))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
