"""Tessera: a PySpark-native analytics engine for dynamic panel data."""
