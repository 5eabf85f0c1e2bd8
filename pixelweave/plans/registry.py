"""Registered queries: a Spark function, the result columns, and (where SQL can say it) an oracle.

Result columns are written ``name:type`` with i (whole number), d (double, rounded to
six digits), s (text) and b (boolean); both sides are cast the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_TYPES = {"i": "bigint", "s": "string", "b": "boolean"}
SQL_TYPES = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: tuple[tuple[str, str], ...]
    oracle: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.build(spark, sf_dir)
        return out.select(*[_spark_cast(c, t) for c, t in self.columns])


QUERIES: dict[str, Query] = {}


def _spark_cast(name: str, kind: str):
    if kind == "d":
        return (F.round(F.col(name).cast("double"), 6) + F.lit(0.0)).alias(name)
    return F.col(name).cast(SPARK_TYPES[kind]).alias(name)


def _sql_cast(name: str, kind: str) -> str:
    if kind == "d":
        return f"(round(CAST({name} AS DOUBLE), 6) + 0.0::DOUBLE) AS {name}"
    return f"CAST({name} AS {SQL_TYPES[kind]}) AS {name}"


def query(name: str, columns: str, ctes: list[str] | None = None, sql: str | None = None):
    """Register a query. ``ctes`` are ``name AS (...)`` fragments put before ``sql``."""
    parsed = tuple(tuple(c.split(":")) for c in columns.split())

    def register(build: Callable[[SparkSession, str], DataFrame]):
        oracle = None
        if sql is not None:
            head = "WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else ""
            select = ", ".join(_sql_cast(c, t) for c, t in parsed)
            oracle = f"{head}SELECT {select} FROM (\n{sql}\n) AS result"
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, build, parsed, oracle)
        return build

    return register


def load_all() -> dict[str, Query]:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        q_background,
        q_calibration,
        q_detection,
        q_health,
        q_lucky,
        q_pixels,
        q_registration,
        q_sky,
        q_sources,
        q_stacking,
        q_statistics,
        q_tiles,
        q_tone,
    )

    return QUERIES
