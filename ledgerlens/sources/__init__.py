"""Staging sources: the CSV contract of the ledger feed, and the projection of
the driver's ``events`` table onto that contract (used by tests and bench)."""

from ledgerlens.sources.staging import (
    read_staging_csv,
    read_table,
    staging_from_events,
    staging_from_sf_dir,
)

__all__ = ["read_staging_csv", "read_table", "staging_from_events", "staging_from_sf_dir"]
