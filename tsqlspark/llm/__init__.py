"""Training-data operators: filtering, deduplication, extraction, mixing and tokenisation.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` list
what ``__spark_entry__.py`` registers.
"""
