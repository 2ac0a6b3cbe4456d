"""Session analytics on Spark: listings, events, sessions, recommendations, benchmarks."""
