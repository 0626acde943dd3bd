"""Plan shapes shared by the operators: skew-safe joins, ordered scans, ranking."""
