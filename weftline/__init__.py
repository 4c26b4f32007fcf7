"""Weftline: a PySpark-native analytics engine for business-correspondence event data."""
