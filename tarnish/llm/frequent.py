"""The most frequent words of a count table, without sorting it and with a bound on what is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 32  # classes of counts for each doubling


def least_count(counts: DataFrame, size: int) -> int:
    """The smallest count that at most `size` rows of `counts` (n) reach, up to the width of a class.

    Counts are gathered in logarithmic classes, of which there are at most 2,016, so the driver sees few
    rows whatever the number of words.
    """
    step = F.floor(F.log2("n") * STEPS)
    rows = counts.filter("n > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).collect()
    reached, least = 0, (1 << 62)
    for r in sorted(rows, key=lambda r: -r["step"]):
        reached += r["k"]
        if reached > size:
            break
        least = r["least"]
    return least


def most_frequent(counts: DataFrame, size: int) -> dict[str, int]:
    """At most `size` of the most frequent words of `counts` (word, n), whole classes of counts."""
    return {r["word"]: r["n"] for r in counts.filter(F.col("n") >= least_count(counts, size)).select("word", "n").collect()}
