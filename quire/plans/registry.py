"""How queries are registered, and SQL building blocks of the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one group with the SQL that gives the same rows (none if SQL can't)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: White space inside a character class, as the text functions take it.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACES}]+', ' ', 'g'), ' ')"


def sql_fold(x: str) -> str:
    return sql_collapse(f"lower(strip_accents(coalesce({x}, '')))")


def sql_lines(extra: str = "") -> str:
    """Lines of all documents as (doc_id, line_no, line)."""
    return f"SELECT doc_id, line_no, ls[line_no] AS line{extra} FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL)"
