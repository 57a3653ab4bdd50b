"""Scan the shop tables from a relational server through Spark's JDBC source.

Needs the server's JDBC driver jar on the Spark classpath.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartlight import schemas
from cartlight.tables import TABLE_NAMES, Tables

# Connection variables and their defaults.
_DEFAULTS = {
    "MYSQL_HOST": "localhost",
    "MYSQL_USER": "root",
    "MYSQL_PASSWORD": "",
    "MYSQL_DATABASE": "shop",
    "MYSQL_PORT": "3306",
}


def connection_options(env: dict[str, str] | None = None) -> dict[str, str]:
    given = os.environ if env is None else env
    value = {key: given.get(key, default) for key, default in _DEFAULTS.items()}
    return {
        "url": f"jdbc:mysql://{value['MYSQL_HOST']}:{int(value['MYSQL_PORT'])}/{value['MYSQL_DATABASE']}",
        "user": value["MYSQL_USER"],
        "password": value["MYSQL_PASSWORD"],
        "driver": "com.mysql.cj.jdbc.Driver",
        "fetchsize": "10000",
    }


def scan_options(
    table: str, lower: int, upper: int, partitions: int, env: dict[str, str] | None = None
) -> dict[str, str]:
    """Options of a parallel scan: ``partitions`` ranges of the primary key between the two bounds."""
    if table not in TABLE_NAMES:
        raise ValueError(f"unknown table {table}")
    return {
        **connection_options(env),
        "dbtable": table,
        "partitionColumn": schemas.PRIMARY_KEYS[table],
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def conformed(rows: DataFrame, table: str) -> DataFrame:
    """The columns of the fixed schema in its types and order, whatever types the server has (DECIMAL, TINYINT, DATETIME).

    Column names match in any case; a missing one is an error, columns beside the schema are left out.
    """
    named = {c.lower(): c for c in rows.columns}
    missing = [f.name for f in schemas.schema(table) if f.name not in named]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return rows.select(*[F.col(f"`{named[f.name]}`").cast(f.dataType).alias(f.name) for f in schemas.schema(table)])


def scan(spark: SparkSession, table: str, partitions: int, env: dict[str, str] | None = None) -> DataFrame:
    """Scan one table in parallel; the key bounds come from one MIN/MAX query on the server."""
    key = schemas.PRIMARY_KEYS[table]
    bounds = (
        spark.read.format("jdbc").options(**connection_options(env))
        .option("query", f"select coalesce(min({key}), 0) lo, coalesce(max({key}), 0) hi from {table}")
        .load().first()
    )
    options = scan_options(table, bounds["lo"], bounds["hi"] + 1, partitions, env)
    return conformed(spark.read.format("jdbc").options(**options).load(), table)


def jdbc_tables(spark: SparkSession, partitions: int, env: dict[str, str] | None = None) -> Tables:
    return Tables({
        name: (lambda name=name: scan(spark, name, partitions, env)) for name in TABLE_NAMES
    })
