"""Operators for building language-model training data, each a Spark job over DataFrames.

Nothing outside this subpackage imports it.
"""
