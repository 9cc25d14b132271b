"""Scalar building blocks: plain Python functions that return Columns."""
