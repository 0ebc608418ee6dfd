"""Operators for preparing language-model training data as Spark jobs.

Nothing outside this subpackage imports it.  ``queries.queries()`` and
``queries.oracle_sql()`` list what ``__spark_entry__`` registers.
"""
