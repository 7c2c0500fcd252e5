"""Numbers cited in texts, reconciled with published values."""

from __future__ import annotations

import math
from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.functions.joins import attach
from tarnish.session import stage

CONTEXT = 90
TOLERANCE = 0.0002
RELATIVE = 1e-4


def joined_numbers(text: Column, decimal: str) -> Column:
    """The text without the blanks that stand between a decimal sign and the digits around it."""
    return F.regexp_replace(text, rf"(?<=[0-9])\s?\{decimal}\s?(?=[0-9])", decimal)


def number_value(token: Column, decimal: str, thousands: str) -> Column:
    """The value of a run of digits and signs by the grammar below, else NULL.

    number := whole decimal-sign fraction; fraction := 1 to 4 digits; whole := digits, or a group of 1 to 3
    digits followed by groups of exactly 3, with a thousands sign before each. Thousands signs at both ends
    of the run, and then one decimal sign at its end, are punctuation of the sentence and do not count.
    """
    run = F.regexp_replace(F.btrim(token, F.lit(thousands)), rf"\{decimal}$", "")
    halves = F.split(run, f"\\{decimal}", -1)
    fraction, groups = F.get(halves, F.lit(1)), F.split(F.get(halves, F.lit(0)), f"\\{thousands}", -1)
    rest = F.slice(groups, 2, F.size(groups))
    grouped = (F.char_length(F.get(groups, F.lit(0))) <= 3) & F.forall(rest, lambda g: F.char_length(g) == 3)
    short = F.char_length(fraction).between(1, 4) & ~F.contains(fraction, F.lit(thousands))
    filled = F.forall(groups, lambda g: F.char_length(g) > 0)
    ok = (F.size(halves) == 2) & short & filled & ((F.size(groups) == 1) | grouped)
    return F.when(ok, F.concat(F.array_join(groups, ""), F.lit("."), fraction).try_cast("double"))


def extract_claims(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", decimal: str = ",", thousands: str = "."
) -> DataFrame:
    """One row per number: (doc_id, claim_no, value, context), the context reaching 90 characters to each side.

    Texts are cut into runs of digits and signs and the gaps between them, and each run is read by
    `number_value`. A context is put together from the nearest of these pieces: a run and a gap have at
    least one character each, so 45 of both fill 90 characters and the work per number is bounded,
    however long the text.
    """
    signs = rf"[0-9\{decimal}\{thousands}]+"
    reach = CONTEXT // 2
    whole = docs.select(F.col(doc_id), joined_numbers(F.col(text), decimal).alias("text"))
    cut = whole.select(
        doc_id, F.regexp_extract_all("text", F.lit(signs), F.lit(0)).alias("numbers"), F.split("text", signs, -1).alias("gaps")
    )
    read = F.transform("numbers", lambda t, i: F.struct(i.alias("at"), number_value(t, decimal, thousands).alias("value")))
    hits = cut.withColumn("hits", F.filter(read, lambda h: h["value"].isNotNull())).filter(F.size("hits") > 0)
    shown = F.expr(f"""
        transform(hits, h -> struct(h.value AS value, numbers[h.at] AS number,
            right(array_join(transform(sequence(greatest(0, h.at - {reach}), h.at), j ->
                concat(if(j > greatest(0, h.at - {reach}), numbers[j - 1], ''), right(gaps[j], {CONTEXT}))), ''), {CONTEXT}) AS before,
            left(array_join(transform(sequence(h.at, least(size(numbers) - 1, h.at + {reach})), j ->
                concat(if(j > h.at, numbers[j], ''), left(gaps[j + 1], {CONTEXT}))), ''), {CONTEXT}) AS after))""")
    found = hits.select(doc_id, F.posexplode(shown).alias("claim_no", "c"))
    context = F.concat(F.col("c.before"), F.col("c.number"), F.col("c.after"))
    return found.select(doc_id, "claim_no", "c.value", F.trim(F.regexp_replace(context, r"\s+", " ")).alias("context"))


def publish(tables: dict[str, DataFrame]) -> DataFrame:
    """Every number of the result tables with its source `table:column`; text that is no number is skipped."""
    parts = []
    for name, df in tables.items():
        cells = F.array(
            *[F.struct(F.col(c).try_cast("double").alias("value"), F.lit(f"{name}:{c}").alias("source")) for c in df.columns]
        )
        parts.append(df.select(F.explode(cells).alias("cell")).select("cell.*").filter("value IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts).distinct()


def accepted_forms(published: DataFrame) -> DataFrame:
    """The forms in which a published value may be cited: to 4, 2 or 1 places, or as a percentage."""
    v = F.col("value")
    forms = F.array(F.round(v, 4), F.round(v * 100, 4), F.round(v, 1), F.round(v, 2))
    return published.select(F.explode(forms).alias("value"), "source").distinct()


def provenance(published: DataFrame) -> DataFrame:
    """Per accepted value: the sources that publish it, sorted."""
    return accepted_forms(published).groupBy("value").agg(F.concat_ws(", ", F.sort_array(F.collect_set("source"))).alias("sources"))


def _slot(v: Column, tolerance: float) -> Column:
    """Integer slots in which two values within the tolerance are equal or neighbours.

    Up to the turning point the tolerance is absolute and slots have its width; beyond, it is relative
    and slots are logarithmic, just as wide as the tolerance reaches downwards.
    """
    turn = tolerance / RELATIVE
    size = F.abs(v)
    far = turn / tolerance + F.log(F.greatest(size, F.lit(turn)) / turn) / -math.log1p(-RELATIVE)
    return F.floor(F.signum(v) * F.when(size <= turn, size / tolerance).otherwise(far)).cast("bigint")


def reconcile_values(claimed: DataFrame, published: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Distinct claimed values with `supported`: an accepted form lies within max(tolerance, |v| / 10,000).

    The band join is an equality on slots as wide as the tolerance. Of a slot only its smallest and its
    largest known value can be nearest to a claim from outside; a claim inside a slot that lies
    between both is within the tolerance of one of them. So the known side is one row per slot, and
    each claim meets three of them at most.
    """
    known = F.col("known")
    forms = accepted_forms(published).select(F.col("value").alias("known")).withColumn("slot", _slot(known, tolerance))
    ends = forms.groupBy("slot").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    values = claimed.select("value").distinct()
    at = _slot(F.col("value"), tolerance)
    near = values.withColumn("slot", F.explode(F.array(at - 1, at, at + 1))).join(ends, "slot", "left")
    limit = F.greatest(F.lit(tolerance), F.abs(F.col("value")) * RELATIVE)
    away = F.least(F.abs(F.col("low") - F.col("value")), F.abs(F.col("high") - F.col("value")))
    return near.groupBy("value").agg(F.coalesce(F.bool_or(away <= limit), F.lit(False)).alias("supported"))


def unsupported_claims(
    claims: DataFrame, published: DataFrame, tolerance: float = TOLERANCE, context_numbers: Collection[float] = ()
) -> DataFrame:
    """The claims that match no published value, without the caller's `context_numbers`."""
    known = F.col("value").isin(*context_numbers) if context_numbers else F.lit(False)
    open_claims = stage(claims.filter(~known))  # the texts are read once
    verdict = reconcile_values(open_claims, published, tolerance)
    sizes = open_claims.groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    per_value = sizes.join(verdict, "value")
    total = sizes.agg(F.sum("_n")).scalar()
    return attach(open_claims, per_value, ["value"], ["supported"], "_n", total).filter(~F.col("supported")).drop("supported")
