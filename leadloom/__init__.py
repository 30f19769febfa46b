"""Lead analytics on Spark DataFrames: extraction, validation, entity resolution, reporting and export."""
