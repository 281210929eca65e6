"""DataFrame operators: joins, pivots, numbering and ordering that hold up under skewed keys."""
