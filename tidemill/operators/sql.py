"""SQL text and user functions over frames and tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_VIEW = "source_data"


def run_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text; ``tables`` are visible under their names while the text is analysed.

    Temporary views of the same names are put back afterwards.
    """
    own = {v.name.lower() for v in spark.catalog.listTables() if v.isTemporary}
    before = {name: spark.table(name) for name in tables or {} if name.lower() in own}
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(query)
    finally:
        for name in tables or {}:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def step_sql(df: DataFrame, query: str) -> DataFrame:
    """Run a query that reads the step's input as ``source_data``."""
    if not query.strip().lower().startswith(("select", "with")):
        raise ValueError("only SELECT queries are allowed in a SQL step")
    return run_sql(df.sparkSession, query, {SOURCE_VIEW: df})


def step_python(df: DataFrame, function: Callable[..., DataFrame], **parameters) -> DataFrame:
    """Apply a user function that maps a frame to a frame."""
    out = function(df, **parameters)
    if not isinstance(out, DataFrame):
        raise ValueError("the function of a Python step must return a DataFrame")
    return out


def step_pandas(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Apply a row-local pandas function to batches of rows on the executors."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield function(part)

    return df.mapInPandas(batches, schema)


def register_udf(spark: SparkSession, name: str, function: Callable, return_type: str) -> None:
    """Make a vectorised function (pandas Series to Series) callable from SQL."""
    spark.udf.register(name, F.pandas_udf(function, return_type))


def describe_table(spark: SparkSession, table: str) -> dict:
    """Columns with type and nullability, and the row count of a table."""
    df = spark.table(table)
    columns = [
        {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema.fields
    ]
    return {"name": table, "columns": columns, "row_count": df.count()}


def list_tables(spark: SparkSession, database: str | None = None) -> list[dict]:
    """Names and kinds of the tables in the catalog."""
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return [{"name": t.name, "type": t.tableType} for t in found]
