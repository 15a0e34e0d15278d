"""Price analytics on Spark: DataFrame operators over price change logs."""
