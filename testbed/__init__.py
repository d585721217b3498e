"""The raw inputs mapped onto the supplied test tables, the query catalogue and its SQL oracles."""
