"""Price-index and simulated-path analytics on Spark."""
