"""Training-data operators: quality filtering, deduplication, packing and the like.

Every operator is a function ``(DataFrame, ...) -> DataFrame``; ``queries.py``
registers each one over its whole table with production parameters.
"""
