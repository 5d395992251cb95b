"""End-to-end plans and the query registry (``queries()`` / ``oracle_sql()``)."""
