"""Index-style lookups as DataFrame functions. A row id is a unique key column that the caller names."""
