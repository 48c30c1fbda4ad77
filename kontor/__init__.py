"""Customer-data quality, matching and enrichment as PySpark DataFrame operators."""
