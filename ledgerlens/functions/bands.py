"""Fixed amount bands (half-open; the top band includes its lower edge).

Rows carry the small integer id; labels are attached to aggregated rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schemas import BAND_LABELS, BAND_LOWER_EDGES


def band_id_sql(amount: str) -> str:
    uppers = BAND_LOWER_EDGES[1:]
    whens = " ".join(f"WHEN {amount} < {u} THEN {i}" for (i, _), u in zip(BAND_LABELS, uppers))
    return f"CAST(CASE {whens} ELSE {BAND_LABELS[-1][0]} END AS INT)"


def band_label_by_id(bid: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in BAND_LABELS for x in kv])[bid]
