"""Column-level helpers. Everything here inlines into the surrounding plan and
stays inside whole-stage codegen."""

from ledgerlens.functions.bands import band_id_sql, band_label_by_id
from ledgerlens.functions.fees import fee_sql, hits_cap_sql, hits_floor_sql, uncapped_fee_sql
from ledgerlens.functions.numeric import as_units, money_from_units, ratio_half_up

__all__ = [
    "as_units", "band_id_sql", "band_label_by_id", "fee_sql", "hits_cap_sql", "hits_floor_sql",
    "money_from_units", "ratio_half_up", "uncapped_fee_sql",
]
