"""Composed stage plans over the generated test tables (``events`` read as a historian)."""
