"""Store-transaction analytics on Spark: ingestion, rollups, reports and demand forecasts."""
