"""Domain tables over the test data, and the registered queries with their SQL."""
