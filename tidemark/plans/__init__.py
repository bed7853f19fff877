"""Whole analyses over the given tables, with their SQL."""
