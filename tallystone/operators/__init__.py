"""Relational operators over files, lines and commits; every function takes and returns lazy DataFrames."""
