"""Small shared expressions for the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.fees import FEE_SCALE
from ledgerlens.functions.numeric import as_units, money_from_units, ratio_half_up

CENT_SCALE = 2


def sum_cents(col: Column | str) -> Column:
    """Exact SUM of a DECIMAL(18,2) column as integer cents (NULL over no rows)."""
    c = F.col(col) if isinstance(col, str) else col
    return as_units(F.sum(c), CENT_SCALE)




def millions(units: str, unit_scale: int = CENT_SCALE, dp: int = 2) -> Column:
    """round(value / 1e6, dp) from exact units given as SQL text."""
    return ratio_half_up(units, 10 ** (6 + unit_scale), dp)


def fee_units_of_cents(name: str) -> str:
    """SQL text: a cents column expressed in fee units."""
    return f"({name}) * {10 ** (FEE_SCALE - CENT_SCALE)}"


def money(units: Column, unit_scale: int = CENT_SCALE) -> Column:
    return money_from_units(units, unit_scale)


def pct(num: str, den: str, dp: int) -> Column:
    """round(100 * num / den, dp) from integer-valued SQL text."""
    return ratio_half_up(f"({num}) * 100", den, dp)


# Sums that every aggregate over cells (Ledger.cells, Ledger.net_cells) keeps.
CELL_COUNTS = ["txn_count", "fraud_txns", "flagged_txns", "flagged_fraud_txns", "txns_hitting_cap", "txns_hitting_floor"]
CELL_UNITS = ["value_cents", "fee_u", "cost_cents", "fraud_cents", "missed_cents"]
LOSS_UNITS = ["loss_cents", "true_cents"]  # of net_cells


def cell_sums(loss: bool = True) -> list[Column]:
    """Aggregates that add up cells; ``hours`` is a bit for each hour seen."""
    counts = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in CELL_COUNTS]
    units = [F.sum(c).alias(c) for c in CELL_UNITS + (LOSS_UNITS if loss else [])]
    return [*counts, *units, F.bit_or("hours").alias("hours")]


def hours_seen() -> Column:
    return F.bit_count(F.col("hours")).cast("long")


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def with_type_names(agg: DataFrame, dim_type: DataFrame | None = None, *extra: str) -> DataFrame:
    """Attach type labels to aggregated rows (after the aggregate, so the
    shuffle carries the small integer key, not the text)."""
    from ledgerlens.operators.star import type_attr_by_key

    key = F.col("transaction_type_key")
    out = agg.withColumn("type_name", type_attr_by_key(key, "type_name"))
    for attr in extra:
        out = out.withColumn(attr, type_attr_by_key(key, attr))
    return out.where(F.col("type_name").isNotNull())


def beside(base: DataFrame, *others: DataFrame) -> DataFrame:
    """The columns of one-row aggregates next to a one-row ``base``: each other
    row is one scalar subquery of a struct (no join of any kind), so its source
    is read once however many columns it has."""
    packed = [other.select(F.struct(*[F.col(f"`{c}`") for c in other.columns])).scalar().alias(f"_row{i}") for i, other in enumerate(others)]
    cols = [F.col(f"`{c}`") for c in base.columns]
    cols += [F.col(f"_row{i}.`{c}`").alias(c) for i, other in enumerate(others) for c in other.columns]
    return base.select("*", *packed).select(*cols)
