"""Property-listing analytics as plain Spark jobs (DataFrame in, DataFrame out)."""
