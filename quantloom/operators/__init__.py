"""Operators on panels: DataFrames with unique keys (Date, Ticker)."""
