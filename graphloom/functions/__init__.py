"""Column functions: text measures, paths, comparisons, aggregations."""
