"""Site-content analytics on PySpark."""
