"""Commerce analytics on Spark: layered ingestion, star schema and business queries as DataFrame functions."""
