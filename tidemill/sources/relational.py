"""Relational tables over JDBC and catalog sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemill.functions.predicates import extraction_predicate
from tidemill.sources.files import extract_columns

# JDBC URL forms and default ports by database kind.
JDBC_URLS = {
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mssql": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "sqlite": "jdbc:sqlite:{database}",
    "derby": "jdbc:derby:{database}",
}
DEFAULT_PORTS = {"mysql": 3306, "postgresql": 5432, "mssql": 1433, "oracle": 1521}


def jdbc_url(config: Mapping[str, Any]) -> str:
    """JDBC URL of a connection config; an explicit ``url`` wins."""
    if config.get("url"):
        return config["url"]
    kind = config.get("db_type", config.get("type", ""))
    if kind not in JDBC_URLS:
        raise ValueError(f"Unsupported database type: {kind}")
    database = config.get("database") or ("postgres" if kind == "postgresql" else "")
    return JDBC_URLS[kind].format(
        host=config.get("host", "localhost"), port=config.get("port", DEFAULT_PORTS.get(kind, "")), database=database
    )


def jdbc_options(config: Mapping[str, Any]) -> dict[str, str]:
    """Reader and writer options of a connection config."""
    options = {"url": jdbc_url(config)}
    for ours, theirs in (("username", "user"), ("password", "password"), ("driver", "driver")):
        if config.get(ours):
            options[theirs] = str(config[ours])
    return options


def read_relational(
    spark: SparkSession,
    config: Mapping[str, Any],
    source: str,
    columns: Sequence[str] | None = None,
    filters: Mapping[str, Any] | None = None,
    order_by: str | None = None,
    partition: Mapping[str, Any] | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Table or ``SELECT`` text of a database; columns and filters are pushed into the database.

    ``partition`` (column, lower, upper, count) makes that many parallel range reads.
    """
    reader = spark.read.format("jdbc").options(**jdbc_options(config)).option("fetchsize", fetch_size)
    is_query = source.strip().lower().startswith(("select ", "with "))
    reader = reader.option("dbtable", f"({source}) q" if is_query else source)
    if partition:
        reader = reader.options(
            partitionColumn=partition["column"], lowerBound=str(partition["lower"]),
            upperBound=str(partition["upper"]), numPartitions=str(partition["count"]),
        )
    df = reader.load()
    if filters:
        df = df.filter(extraction_predicate(df, filters))
    df = extract_columns(df, columns, strict=True)
    return df.orderBy(order_by) if order_by else df


def write_jdbc(
    df: DataFrame, config: Mapping[str, Any], table: str, mode: str = "append", batch_size: int = 1000
) -> None:
    """Write rows to a database table in batches."""
    writer = df.write.format("jdbc").options(**jdbc_options(config)).option("dbtable", table)
    writer.option("batchsize", batch_size).mode(mode).save()


def load_source(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """Frame of a source config with a ``query`` or a ``table_name``."""
    if config.get("query"):
        return spark.sql(config["query"])
    if config.get("table_name"):
        return spark.table(config["table_name"])
    raise ValueError("a source needs a query or a table_name")
