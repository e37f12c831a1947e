"""Operators for building training corpora.

The ten operators are independent of the rest of the package: nothing outside this folder imports it.
"""
