"""Plans: the ``Ledger`` model every mart reads, the query registry with its
independent SQL oracles, and the pipeline that writes the star and marts."""
