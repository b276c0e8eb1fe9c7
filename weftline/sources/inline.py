"""Small tables given in code, as DataFrames and as SQL: dimensions and fixtures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SQL = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


@dataclass(frozen=True)
class Inline:
    name: str
    schema: str  # "name type, name type"
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def cte(self) -> str:
        columns = [c.strip().split(" ") for c in self.schema.split(", ")]
        names = ", ".join(c for c, _ in columns)
        casts = ", ".join(f"CAST({c} AS {_SQL[t]}) AS {c}" for c, t in columns)
        values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in self.rows)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {values}) AS v({names}))"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"
