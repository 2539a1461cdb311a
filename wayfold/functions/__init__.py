"""Column functions: no UDF, no job, code-generated by Spark."""
