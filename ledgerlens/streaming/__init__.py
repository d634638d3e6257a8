"""Incremental ingestion of the ledger feed with Structured Streaming.

The reference has no streaming operators; what it does have is a bulk CSV
load into staging followed by a full rebuild. ``landing`` re-expresses the
load as an exactly-once, restartable file stream (new CSV files in a landing
folder are appended to the staging table); the star and marts are then
rebuilt from staging by ``plans.pipeline``.
"""

from ledgerlens.streaming.landing import land_staging

__all__ = ["land_staging"]
