"""Operators for preparing training text at scale.

Nothing outside this folder imports it. ``catalog.QUERIES`` holds the queries,
``catalog.ORACLE_SQL`` their SQL where SQL can say the same.
"""
