"""cairnspark: composite-index analytics on PySpark."""
