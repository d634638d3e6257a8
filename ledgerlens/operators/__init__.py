"""DataFrame operators. Each takes DataFrames (or a ``Ledger``) and returns a
lazy DataFrame; no operator collects data to the driver."""
