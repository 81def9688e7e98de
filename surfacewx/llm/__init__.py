"""Operators for preparing language-model training data, each a function on
DataFrames. Nothing outside this subpackage imports it; the queries that run
the operators on the test tables are in ``queries``."""
