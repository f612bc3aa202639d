"""Session-history analytics expressed as Spark DataFrames."""
