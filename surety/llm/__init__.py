"""Operators for training-data pipelines.

Nothing outside this subpackage imports it.  Each operator module has a general
interface; ``contracts`` holds the thin ``opN_*`` queries built on them.
"""
