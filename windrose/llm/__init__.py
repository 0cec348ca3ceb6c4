"""Training-data operators: filters, extraction, deduplication and tokenisation of text tables.

Nothing else in the library imports this subpackage; its queries are in :mod:`windrose.llm.catalog`.
"""
