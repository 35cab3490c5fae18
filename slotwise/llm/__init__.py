"""Operators of a training-data pipeline over very large corpora.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their SQL; every other module holds one operator.
"""
