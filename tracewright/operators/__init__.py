"""Operators over the event log; each takes and returns DataFrames."""
