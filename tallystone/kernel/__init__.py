"""The kernel of a file: line classes, functions, complexity and inline tests of one text. Plain Python without Spark."""
