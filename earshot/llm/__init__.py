"""Operators of a text training-data pipeline. Nothing else in the library imports this subpackage."""
