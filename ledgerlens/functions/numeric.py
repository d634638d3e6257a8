"""Exact decimal rounding policy.

Money stays DECIMAL through every sum. A published ratio or rounded figure is
computed from *integer units* (cents for money, 1e-7 for fees) by integer
half-away-from-zero division and only then turned into a DOUBLE:

    round(n / d, s) = sign(n*d) * floor((2*|n|*10^s + |d|) / (2*|d|)) / 10^s

Decimal ÷ decimal in Spark keeps at most 6 fractional digits at wide
precision and a second ROUND would round twice; the integer form is exact in
any engine. A zero or NULL denominator yields NULL (the NULLIF guard).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_INT = "decimal(38,0)"


def as_units(value: Column, scale: int) -> Column:
    """Exact integer count of 10^-scale units in a decimal value.

    The caller guarantees ``value`` has at most ``scale`` fractional digits and
    that precision(value) + scale + 1 <= 38 (e.g. a SUM of DECIMAL(18,2) is
    DECIMAL(28,2), so scale 2 is exact)."""
    return (value * F.lit(10**scale)).cast(WIDE_INT)


def ratio_sql(num: str, den: str, scale: int) -> str:
    """The same rule as Spark SQL text over integer-valued expressions."""
    n = f"CAST(({num}) AS DECIMAL(38,0))"
    d = f"CAST(({den}) AS DECIMAL(38,0))"
    p = 10**scale
    q = f"((abs({n}) * {2 * p} + abs({d})) div (2 * abs({d})))"
    # a plain CASE rather than NULLIF: NULLIF becomes a common-expression
    # projection that hides a Sort from the top-k (TakeOrderedAndProject) rule
    return (f"(CAST(CASE WHEN {d} = 0 THEN NULL WHEN ({n} < 0) <> ({d} < 0) THEN -{q} ELSE {q} END AS DOUBLE)"
            f" / {p}D)")


def ratio_half_up(num: str | int, den: str | int, scale: int) -> Column:
    """round(num / den, scale) half away from zero, exact, as DOUBLE.

    ``num`` and ``den`` are SQL text of integer-valued expressions (counts or
    unit sums); either may be negative. den = 0 or NULL gives NULL."""
    return F.expr(ratio_sql(str(num), str(den), scale))


def money_from_units(units: Column, unit_scale: int = 2) -> Column:
    """Exact unit count back to a DOUBLE money figure (cents / 100)."""
    return units.cast(WIDE_INT).cast("double") / F.lit(float(10**unit_scale))
