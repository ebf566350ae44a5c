"""Operators on DataFrames: each takes and returns DataFrames, plus small fitted statistics."""
