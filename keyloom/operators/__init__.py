"""Operators on ordered key-value tables: DataFrames with a unique `key`, and a `value`."""
