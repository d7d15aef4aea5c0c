"""News-stream analytics on PySpark."""
