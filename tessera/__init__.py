"""Tessera: a PySpark-native analytics engine for structural and vector data."""
