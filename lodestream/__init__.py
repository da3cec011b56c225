"""lodestream: a PySpark-native analytics engine for monitoring data.

Operators are plain functions from DataFrame to DataFrame; queries compose them.
"""
