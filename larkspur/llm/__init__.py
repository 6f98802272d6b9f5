"""Training-data operators: tokenising, scoring, de-duplication, scanning and packing of documents.

Nothing else in the library imports this package.
"""
