"""The hybrid fee rule as SQL text: a percentage of the amount, clamped to
[floor, cap]. The marts and the clamp test use these same texts, which inline
into the aggregate that sums them."""

from __future__ import annotations

# Per-row fee precision: DECIMAL(18,2) amount x DECIMAL(6,5) rate has 7
# fractional digits; fee units are 1e-7 of the currency unit.
FEE_SCALE = 7


def fee_sql(amount: str, rate: str, fee_min: str, fee_max: str) -> str:
    """A zero rate, floor and cap give 0."""
    return f"least({uncapped_fee_sql(amount, rate, fee_min)}, {fee_max})"


def uncapped_fee_sql(amount: str, rate: str, fee_min: str) -> str:
    """The fee without its cap (the floor stays)."""
    return f"greatest({amount} * ({rate}), {fee_min})"


def hits_cap_sql(amount: str, rate: str, fee_max: str) -> str:
    return f"{amount} * ({rate}) > {fee_max}"


def hits_floor_sql(amount: str, rate: str, fee_min: str) -> str:
    """Strictly below the floor; a fee equal to the floor is not a hit."""
    return f"{amount} * ({rate}) < {fee_min}"
