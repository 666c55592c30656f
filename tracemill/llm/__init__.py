"""Operators for preparing training text.

Every operator takes DataFrames and returns a DataFrame. Nothing outside this
subpackage imports it.
"""
