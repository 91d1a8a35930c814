"""Operators that a large-scale training-data pipeline needs.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its
queries when it can be imported.
"""
