"""Inconsistency analytics on Spark: dependencies, conflicts, controlled noise, evaluation, statistics."""

from tarnish.model import FD, configurations, corrupted_columns, redundancy_dependencies

__all__ = ["FD", "configurations", "corrupted_columns", "redundancy_dependencies"]
