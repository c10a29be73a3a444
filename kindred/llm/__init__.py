"""Operators of a large-scale training-data pipeline.

Tasks import these modules by name, so a cluster needs the package on its executors (``--py-files``).
Nothing outside this package imports it.
"""
