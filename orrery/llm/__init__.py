"""Training-data operators: filtering, deduplication, tokenisation and packing of document tables.

Nothing else in the library imports this subpackage.
"""
