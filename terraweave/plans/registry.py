"""All registered queries and the SQL each is compared with."""

from . import space_queries, space_sql, stream_queries, stream_sql, text_queries, text_sql

QUERIES = {**text_queries.QUERIES, **space_queries.QUERIES, **stream_queries.QUERIES}
SQL = {**text_sql.SQL, **space_sql.SQL, **stream_sql.SQL}
