"""Column functions: phases, ratios, strata, intervals and hashes."""
