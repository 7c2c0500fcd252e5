"""Numeric expressions that Spark SQL lacks, written with built-ins only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 1000


def pairs(n: Column) -> Column:
    """Unordered pairs among n rows, exact for any row count."""
    wide = n.cast("decimal(19,0)")
    return (wide * (wide - 1) / 2).cast("decimal(38,0)")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def t_two_sided_sql(t: str, df: str, total: str | None = None) -> str:
    """SQL for the two-sided tail P(|T| > |t|) of Student's t with (possibly fractional) df >= 1.

    The tail is the ratio of two integrals of cos^(df-1), from atan(|t|/sqrt(df)) and from 0 to pi/2,
    each by Simpson's rule. A range ends where the integrand falls below e^-40 of its start, so narrow
    peaks (large df) stay resolved; with x = far end - span * u^4 it is smooth for every df >= 1.
    `total` is the dialect's way to sum an expression over i = 0..STEPS.
    """
    total = total or f"aggregate(sequence(0, {STEPS}), 0e0, (acc, i) -> acc + {{body}})"
    u = f"(i * 1e0 / {STEPS})"
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END)"

    def area(low: str) -> str:
        span = f"(acos(cos({low}) * exp(-40e0 / greatest({df} - 1e0, 1e-9))) - {low})"
        x = f"({low} + {span} * (1e0 - pow({u}, 4)))"
        value = f"(pow(greatest(cos({x}), 0e0) / cos({low}), {df} - 1e0) * 4e0 * pow({u}, 3) * {span})"
        return total.format(body=f"{weight} * {value}")

    low = f"atan(abs({t}) / sqrt({df}))"
    ratio = f"pow(cos({low}), {df} - 1e0) * {area(low)} / {area('0e0')}"
    return f"(CASE WHEN {t} IS NULL OR {df} IS NULL OR {df} <= 0e0 THEN NULL ELSE least(1e0, {ratio}) END)"


def t_two_sided(t: str, df: str) -> Column:
    """Two-sided p-value of Student's t; `t` and `df` are column names or SQL expressions."""
    return F.expr(t_two_sided_sql(t, df))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rest(v: Column, scale: Column, product: Column) -> Column:
    """v * scale - product, exactly: both factors are split in halves of 26 bits."""

    def halves(x: Column) -> Column:
        big = bound(x * F.lit(134217729e0), lambda c: c - (c - x))
        return bound(big, lambda high: F.struct(high.alias("high"), (x - high).alias("low")))

    def error(a: Column, b: Column) -> Column:
        cross = (a["high"] * b["high"] - product) + a["high"] * b["low"] + a["low"] * b["high"]
        return cross + a["low"] * b["low"]

    return bound(halves(v), lambda a: bound(halves(scale), lambda b: error(a, b)))


def scaled_whole(v: Column, power: Column) -> Column:
    """v * 10^power (v >= 0) rounded to a whole number as its exact binary value asks for, halves to even.

    Where the product (for a negative power, the quotient) looks like a half, its exact remainder decides.
    """
    step = F.pow(F.lit(10e0), F.abs(power))

    def decided(product: Column, scale: Column) -> Column:
        down = F.floor(product).cast("double")
        rest = F.when(power < 0, v - (down + 0.5) * scale).otherwise(_rest(v, scale, product))
        half = F.when(rest > 0, down + 1).when(rest < 0, down).otherwise(down + down % 2)
        return F.when(product - down == 0.5, half).otherwise(F.floor(product + 0.5).cast("double"))

    product = lambda scale: F.when(power < 0, v / scale).otherwise(v * scale)
    return bound(step, lambda scale: bound(product(scale), lambda x: decided(x, scale)))


def g6(name: str) -> Column:
    """A numeric column as text with six significant digits, trailing zeros dropped (the C format %g); NULL is empty."""
    v = F.col(f"`{name}`").cast("double")

    def bare(x: Column) -> Column:
        return F.regexp_replace(x.cast("decimal(20,10)").cast("string"), "[.]?0+$", "")

    def text(size: Column, exponent: Column, digits: Column) -> Column:
        sign = F.when(exponent < 0, "-").otherwise("+")
        power = F.when(F.abs(exponent) < 10, F.concat(F.lit("0"), F.abs(exponent).cast("string"))).otherwise(F.abs(exponent).cast("string"))
        plain = bare(digits / F.pow(F.lit(10e0), 5 - exponent))
        return F.when((exponent >= -4) & (exponent < 6), plain).otherwise(F.concat(bare(digits / 1e5), F.lit("e"), sign, power))

    def rounded(size: Column, raw: Column) -> Column:
        # Rounding to six digits can reach the next power of ten.
        digits = scaled_whole(size, 5 - raw)
        return bound(digits, lambda d: F.when(d >= 1e6, text(size, raw + 1, F.lit(1e5))).otherwise(text(size, raw, d)))

    def shown(size: Column) -> Column:
        return bound(F.floor(F.log10(size)).cast("int"), lambda raw: rounded(size, raw))

    minus = F.when(v < 0, "-").otherwise("")
    return F.when(v.isNull(), "").when(v == 0, "0").otherwise(F.concat(minus, bound(F.abs(v), shown)))
