"""Column functions. All of them build native expressions, none is a Python UDF."""
