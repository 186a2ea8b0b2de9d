"""Column functions: paths, text, scores and formats. All are built-in expressions, none is a UDF."""
