"""Operators: each takes and returns DataFrames and runs no job of its own unless it says so."""
