"""Training-data operators: tokenisation, deduplication, filtering, search and packing.

Nothing else in the library imports this subpackage.  Each module holds one
operator; :mod:`emberflow.llm.queries` registers the queries that apply them to
whole tables.
"""
