"""Importance resampling towards a target: hashed n-gram features, Gumbel top-k, cutoff by bracketed quantiles."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.helpers import map_batches, marked_words, quoted, share, shared_value
from tidemill.operators.ordering import dense_ids
from tidemill.session import materialize

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
#: Half the width of the first bracket as a share of the rows; the sketch errs by a fifth of it.
MARGIN = 0.0005


def feature_buckets(words: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Bucket of every run of 1 to ``longest`` words joined by a space, repeats counted: crc32 of its bytes.

    A run's checksum goes on from that of the run without its last word, so each word is read ``longest`` times.
    """
    spaced = [b" " + w for w in words]
    ends = list(map(zlib.crc32, words))
    found = [np.fromiter(ends, np.uint32, len(ends))]
    for k in range(1, longest):
        ends = list(map(zlib.crc32, spaced[k:], ends))
        found.append(np.fromiter(ends, np.uint32, len(ends)))
    return np.concatenate(found) % np.uint32(buckets)


def bucket_counts(documents: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts each bucket holds.

    Each task adds up its own texts and gives one row per bucket; the driver gets ``buckets`` sums.
    """
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for part in parts:
            for raw in part.column(0).to_pylist():
                own += np.bincount(feature_buckets(marked_words(raw), buckets, longest), minlength=buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at])], names=["bucket", "features"])

    found = map_batches(documents.select(quoted(text).cast("binary").alias("text")), count, "bucket bigint, features bigint")
    out = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("features").alias("features")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["features"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of its smoothed share of the target over that of the raw texts)."""
    n = len(raw)
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def score_documents(
    documents: DataFrame, gains: np.ndarray, id_column: str = "doc_id", text: str = "text", seed: int = 42, longest: int = LONGEST,
) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` per row: the sum of its features' gains, and that plus Gumbel noise.

    The noise hangs on seed and id alone, a null id counting as empty, so reruns agree.
    """
    rows = documents.select(quoted(id_column).alias("id"), quoted(text).cast("binary").alias("text"))
    table = share(documents.sparkSession, gains)  # one number per bucket

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared_value(table)
        for part in parts:
            found = []
            for raw in part["text"].to_pylist():
                words = marked_words(raw)
                at = feature_buckets(words, len(values), longest)
                found.append((len(words), len(at), int(values[at].sum())))
            columns = zip(*found, strict=True) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([part["id"], *(pa.array(c, pa.int64()) for c in columns)], names=["id", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    weighed = map_batches(rows, add, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    chance = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.log(-F.log(chance))))


def _order(rows: DataFrame) -> Column:
    """Sorts as the draw does: high scores, then small ids (null last), then few features."""
    return F.struct((-F.col("score")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("n_features").alias("d"))


def cutoff(rows: DataFrame, share_of: tuple[int, int], margin: float = MARGIN):
    """Place of the last row drawn in the order of the draw, and how many rows are drawn: ``(row or None, drawn)``.

    ``floor(n * share)`` rows are drawn. A mergeable quantile sketch gives a ladder of brackets around the score of the
    last of them, the last bracket being the whole range. Exact counts of the rows above and inside validate a bracket;
    where the cutoff lies outside, the next wider one is tried. Only the rows inside it are sorted.
    """
    num, den = share_of
    wanted = 1 - num / den
    steps = [margin * 4**i for i in range(12) if margin * 4**i < 1]
    places = [p for s in steps for p in (max(0.0, wanted - s), min(1.0, wanted + s))]
    accuracy = int(5 / margin)
    total, low, high, marks = rows.agg(
        F.count(F.lit(1)), F.min("score"), F.max("score"), F.percentile_approx("score", places or [wanted], accuracy)).first()
    drawn = total * num // den
    if not drawn:
        return None, 0
    brackets = [(marks[2 * i], marks[2 * i + 1]) for i in range(len(steps))]
    for least, most in [*brackets, (low, high)]:
        above, inside = rows.agg(
            F.count(F.when(F.col("score") > most, 1)), F.count(F.when(F.col("score").between(least, most), 1))).first()
        if above < drawn <= above + inside:
            break
    within = dense_ids(rows.where(F.col("score").between(least, most)).select("score", "id", "n_features", _order(rows).alias("o")), ["o"], "place")
    return within.where(F.col("place") == drawn - above).first(), drawn


def resample(
    documents: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text",
    share_of: tuple[int, int] = (5, 100), least_words: int = LEAST_WORDS, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST,
    margin: float = MARGIN,
) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` per row of ``documents``; the rows drawn have a rank from 1.

    Of the n rows with at least ``least_words`` words the floor(n * share) highest scores are drawn; ties go to the
    smaller id (null last), then to fewer features; rows that are alike in all of this are interchangeable and
    exactly as many of them are drawn as fit. Repeated rows are documents of their own. Null and empty texts have no
    features and weight 0. An empty table, or one too small for a single draw, gives no rank; an empty target weighs
    as if it held each bucket equally often.

    Texts are read twice, each time without a shuffle; the scores, a few numbers a row, live in the shared folder.
    """
    gains = bucket_gains(bucket_counts(documents, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    scored = materialize(score_documents(documents, gains, id_column, text, seed, longest))
    able = scored.where(F.col("n_words") >= least_words)
    last, drawn = cutoff(able, share_of, margin)
    plain = [F.col("id").alias(id_column), "n_features", "weight", "score"]
    if last is None:
        return scored.select(*plain, F.lit(None).cast("bigint").alias("rank"))
    kind = scored.select(_order(scored).alias("o")).schema["o"].dataType
    mark = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last["o"], kind, strict=True)])
    ahead = (F.col("n_words") >= least_words) & (_order(scored) <= mark)
    ranked = dense_ids(scored.where(ahead).withColumn("o", _order(scored)), ["o"], "place")
    # rows equal to the last one in every respect may be too many
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    return ranked.select(*plain, rank.alias("rank")).unionAll(
        scored.where(~ahead).select(*plain, F.lit(None).cast("bigint").alias("rank")))
