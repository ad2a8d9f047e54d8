"""Governed analytics on PySpark: typed plans over a semantic layer, lowered to DataFrame operations."""
