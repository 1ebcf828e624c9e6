"""Registered queries: a Spark plan over the driver tables plus, where possible, an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .roles import Tables, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _tidy(df: DataFrame, digits: int) -> DataFrame:
    """Round doubles and widen small integers, so both engines hash the same values."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(cols)


def query(name: str, *, sql: str | None = None, use: str = "", dbl: str = "", digits: int = 6):
    """Register ``fn(tables)``. ``sql`` may start with its own CTEs after the shared ones named in ``use``;
    ``dbl`` lists the double columns the SQL side must round."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _tidy(fn(Tables.of(spark, sf_dir)), digits)

        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            shared = ctes(*use.split())
            if body.upper().startswith("WITH RECURSIVE "):
                body = (shared.replace("WITH ", "WITH RECURSIVE ", 1) + ", " if shared else "WITH RECURSIVE ") + body[15:]
            elif body.upper().startswith("WITH "):
                body = (shared + ", " if shared else "WITH ") + body[5:]
            elif shared:
                body = f"{shared} {body}"
            if dbl:
                fix = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in dbl.split())
                body = f"SELECT * REPLACE ({fix}) FROM ({body})"
            ORACLES[name] = body
        return fn

    return wrap
