"""Operators that a training-data pipeline needs, on DataFrames of documents, vectors, pages and chats.

Nothing else in the library imports this subpackage.
"""
