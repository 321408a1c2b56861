"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its general interface; ``queries`` registers
the thin queries over them. Nothing else in the library imports this package.
"""
