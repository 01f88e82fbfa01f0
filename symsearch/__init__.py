"""Search and relate program symbols, and other name-rich tables, with Spark."""
