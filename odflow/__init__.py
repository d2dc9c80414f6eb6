"""Origin-destination flow analytics on PySpark DataFrames."""
