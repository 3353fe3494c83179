"""Line dedup across documents: batches of line hashes against levelled runs of all lines seen before."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemill.llm.helpers import map_batches, new_name, plus, quoted, with_text
from tidemill.session import scratch_path

MIN_CHARS = 10
BATCHES = 4
RUNS_PER_LEVEL = 2
_SAMPLE = 1000
KEY = ["k1", "k2"]


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128-bit hash of a line without outer white space and with A-Z lower-cased; None if it is too short."""
    line = line.strip().lower()
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    digest = hashlib.blake2b(line, digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


class LevelledRuns:
    """Line keys seen so far, in sorted runs in the shared folder; full levels are merged into one run of the next."""

    def __init__(self, spark, runs_per_level: int):
        self.spark, self.full = spark, runs_per_level
        self.levels: list[list[str]] = []

    def add(self, keys: DataFrame, level: int = 0) -> None:
        """Write ``keys`` as a run, sorted within hash partitions, and compact the level if it is full."""
        path = scratch_path(self.spark, f"run_{level}")
        keys.repartition(*KEY).sortWithinPartitions(*KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.full:
            merged = self.spark.read.parquet(*self.levels[level])
            self.levels[level] = []
            self.add(merged, level + 1)

    def seen(self) -> DataFrame | None:
        """All keys of all runs; no key is in two runs."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None


def id_cuts(rows: DataFrame, batches: int) -> list[Column]:
    """Ids that cut the rows into ``batches`` ranges of about the same size, as literals of the id's own type and order.

    They come from 1,000 ids, those of the smallest hashes, so reruns agree.
    """
    if batches <= 1:
        return []
    kind = rows.schema["id"].dataType
    sample = rows.where(F.col("id").isNotNull()).select("id").orderBy(F.xxhash64("id"), "id").limit(_SAMPLE)
    ids = [r["id"] for r in sample.orderBy("id").collect()]
    picked = [ids[i * len(ids) // batches] for i in range(1, batches)] if ids else []
    return [F.lit(x).cast(kind) for i, x in enumerate(picked) if x not in picked[:i]]


def repeated_lines(
    documents: DataFrame, id_column: str, text: str, min_chars: int = MIN_CHARS, batches: int = BATCHES,
    runs_per_level: int = RUNS_PER_LEVEL,
) -> DataFrame:
    """``(id, k1, k2)``: the line keys that a document loses, as a smaller id has the line.

    Documents are taken in ``batches`` by ranges of the id, smallest first, null ids last. Each batch reduces its lines
    to one row per key (combined before the shuffle, so a frequent line is no hot key), joins the runs of earlier
    batches, and adds the keys that are new as a run of its own. Texts are read once; later steps see hashes only.
    """
    spark = documents.sparkSession
    rows = documents.select(quoted(id_column).alias("id"), quoted(text).cast("binary").alias("text"))
    cuts = id_cuts(rows, batches)
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.when(F.col("id") > cut, 1).otherwise(0)
    rows = rows.select("id", "text", F.coalesce(F.when(F.col("id").isNull(), F.lit(len(cuts))).otherwise(batch), F.lit(len(cuts))).alias("batch"))

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, first, second = [], [], []
            for i, raw in enumerate(part["text"].to_pylist()):
                for key in {line_key(x, min_chars) for x in raw.split(b"\n")} - {None} if raw else ():
                    at.append(i)
                    first.append(key[0])
                    second.append(key[1])
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part["id"].take(where), part["batch"].take(where), pa.array(first, pa.int64()), pa.array(second, pa.int64())],
                names=["id", "batch", *KEY])

    kind = rows.schema["id"].dataType.simpleString()
    path = scratch_path(spark, "line_keys")
    map_batches(rows, hashes, f"id {kind}, batch int, k1 bigint, k2 bigint").write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(f"id {kind}, k1 bigint, k2 bigint, batch int").parquet(path)
    runs, lost = LevelledRuns(spark, runs_per_level), []
    for number in range(len(cuts) + 1):
        own = keys.where(F.col("batch") == number)
        firsts = own.groupBy(*KEY).agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n"))
        seen = runs.seen()
        if seen is None:
            firsts = firsts.withColumn("old", F.lit(False))
        else:
            firsts = firsts.join(seen.select(*KEY, F.lit(True).alias("__old")), KEY, "left")
            firsts = firsts.withColumn("old", F.coalesce("__old", F.lit(False))).drop("__old")
        at = scratch_path(spark, "batch_keys")
        firsts.write.parquet(at)
        firsts = spark.read.parquet(at)
        if number < len(cuts):
            runs.add(firsts.where(~F.col("old")).select(*KEY))
        repeated = firsts.where(F.col("old") | (F.col("n") > 1))
        lost.append(own.join(repeated, KEY).where(F.col("old") | ~F.col("id").eqNullSafe(F.col("owner"))).select("id", *KEY))
    result = lost[0]
    for more in lost[1:]:
        result = result.unionAll(more)
    return result


def dedup_lines(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars",
    min_chars: int = MIN_CHARS, batches: int = BATCHES, runs_per_level: int = RUNS_PER_LEVEL,
    lines_column: str = "n_lines", dropped_column: str = "n_dropped",
) -> DataFrame:
    """``documents`` without the lines that a document with a smaller id has, plus line counts before and dropped.

    Two lines are the same if they agree without outer white space and with A-Z lower-cased; lines with fewer than
    ``min_chars`` code points then always stay, and a line repeated within its first document stays too. Rows with the
    same id are one document; a null id is the largest. Null and empty texts are one empty line, and null stays null.
    Other columns pass through; columns named like the two counts are replaced.
    """
    spark_names = [c for c in documents.columns if c not in (lines_column, dropped_column)]
    kept = documents.select(*[quoted(c) for c in spark_names])
    lost = repeated_lines(kept, id_column, text, min_chars, batches, runs_per_level)
    key, drop = new_name(kept, "lost_id"), new_name(kept, "lost_keys")
    per_document = lost.groupBy(F.col("id").alias(key)).agg(F.collect_set(F.struct(*KEY)).alias(drop))
    joined = kept.join(per_document, quoted(id_column).eqNullSafe(quoted(key)), "left").select(*[quoted(c) for c in spark_names], quoted(drop))
    at = spark_names.index(text)
    sizes = spark_names.index(n_chars) if n_chars in spark_names else None

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(at).to_pylist()
            total, dropped, changed = [], [], set()
            for i, (value, keys) in enumerate(zip(texts, part.column(part.num_columns - 1).to_pylist(), strict=True)):
                if not keys:
                    total.append(value.count("\n") + 1 if value else 1)
                    dropped.append(0)
                    continue
                gone = {(k["k1"], k["k2"]) for k in keys}
                lines = value.encode().split(b"\n")
                left = [x for x in lines if line_key(x, min_chars) not in gone]
                total.append(len(lines))
                dropped.append(len(lines) - len(left))
                if len(left) < len(lines):
                    texts[i] = b"\n".join(left).decode()
                    changed.add(i)
            body = with_text(part, at, texts, sizes, changed) if changed else part
            yield pa.RecordBatch.from_arrays(
                [*body.columns[:-1], pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*spark_names, lines_column, dropped_column])

    schema = plus(kept.schema, **{lines_column: LongType(), dropped_column: LongType()})
    return map_batches(joined, apply, schema)
