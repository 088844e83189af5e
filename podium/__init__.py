"""Leaderboards and game analytics as PySpark DataFrame operators.

Every operator takes DataFrames shaped as in :mod:`podium.schemas` and returns a DataFrame.
"""
