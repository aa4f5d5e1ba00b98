"""Crawl-audit analytics on Spark: DataFrame operators, sources, plans and a streaming landing zone."""
