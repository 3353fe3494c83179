"""Helpers shared by the operators: tables, Arrow batches and words."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tidemill.session import tune

BATCH_ROWS = 256

# Lower-cases A-Z and turns every byte that is no ASCII letter, digit or part of a longer UTF-8
# sequence into a space, so that split() yields the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read by Spark."""
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of few rows: long texts must not add up to gigabytes in one batch."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def share(spark: SparkSession, value) -> Broadcast[bytes]:
    """Broadcast a value of bounded size, its classes included, so that workers need no package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(shared: Broadcast[bytes]):
    """What ``share`` sent, once per task."""
    return pickle.loads(shared.value)


def plus(schema: StructType, **added: DataType) -> StructType:
    """The schema with more columns."""
    return StructType([*schema.fields, *(StructField(name, kind) for name, kind in added.items())])


def marked_words(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased; null has none."""
    return text.lower().split() if text else []


def new_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name when the frame (in any case) has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_text(batch: pa.RecordBatch, at: int, texts: list[str | None], sizes: int | None, changed) -> pa.RecordBatch:
    """The batch with other texts in column ``at``; ``sizes`` gets the code points of those in the rows ``changed``."""
    columns = list(batch.columns)
    columns[at] = pa.array(texts, batch.schema.field(at).type)
    if sizes is not None:
        counts = columns[sizes].to_pylist()
        for i in changed:
            counts[i] = None if texts[i] is None else len(texts[i])
        columns[sizes] = pa.array(counts, batch.schema.field(sizes).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
