"""Place, address, movement and usage analytics on Spark tables."""
