"""Domain views over the driver tables and the query catalogue."""
