"""Operators for preparing language-model training corpora on Spark.

Nothing outside this package imports it.
"""
