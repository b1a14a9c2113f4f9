"""Incremental document indexing and training-data preparation on PySpark."""
