"""The data products: pure functions from tables to tables."""
