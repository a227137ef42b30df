"""Operators of a training-data pipeline: text in, decisions out, one module each.

Nothing outside this subpackage imports it.
"""
