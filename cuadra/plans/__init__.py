"""Whole runs: contract, artifacts, command line, and the queries over the driver's tables."""
