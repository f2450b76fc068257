"""Operators on event logs; each takes and returns DataFrames."""
