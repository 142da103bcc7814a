"""What the query modules share: the registry, and SQL texts of common steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import columns as C

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Stands for a line break in literal rows.
LINE = "¶"


def query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rows_of(*rows) -> str:
    """Literal rows as SQL that both engines read."""
    def cell(x):
        if x is None:
            return "NULL"
        return quoted(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)

    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {quoted('(?i)' + pattern)})"


def sql_steps(col: str, steps) -> str:
    for pattern, by in steps:
        by = by.replace("$1", "\\1").replace("$2", "\\2")
        col = f"regexp_replace({col}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return col


def sql_trim(col: str) -> str:
    return f"regexp_replace({col}, {quoted(f'^{C.BLANK}+|{C.BLANK}+$')}, '', 'g')"


def sql_squeeze(col: str) -> str:
    return sql_trim(f"regexp_replace({col}, {quoted(C.BLANK + '+')}, ' ', 'g')")


def sql_all(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({col}, {quoted(pattern)}, {group})"


def sql_fold(items: str, step: str) -> str:
    """A fold over a list of strings; ``step`` sees ``acc`` (list of strings) and ``x``."""
    return f"list_reduce(list_transform({items}, lambda y: [y]), lambda acc, z: {step.replace('{x}', 'z[1]')}, CAST([] AS VARCHAR[]))"
