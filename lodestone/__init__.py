"""Research-corpus analytics on PySpark."""
