"""Column-level helpers: time arithmetic, key/value extraction, cohort predicates."""
