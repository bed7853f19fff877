"""Operators on diaries, windows, labels and summaries; each takes and returns DataFrames."""
