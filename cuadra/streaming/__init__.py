"""Statements that arrive over time."""
