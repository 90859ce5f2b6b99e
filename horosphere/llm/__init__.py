"""Operators for large training-data corpora (documents, pages, benchmark).

One module per operator; ``catalog`` holds the registered queries and their
SQL. Nothing outside this folder imports it.
"""
