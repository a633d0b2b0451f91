"""DataFrame operators: each takes and returns DataFrames, with half-open intervals [s, e) inside."""
