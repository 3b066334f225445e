"""Column expressions; all are built-in Spark SQL expressions, none is a Python UDF."""
