"""Tidemark: panel analytics for daily price series and company reports, on PySpark."""
