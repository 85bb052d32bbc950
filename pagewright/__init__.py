"""Document passage search and corpus preparation on PySpark."""
