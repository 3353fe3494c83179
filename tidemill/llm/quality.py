"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemill.llm.helpers import map_batches, new_name, plus, quoted
from tidemill.session import materialize

MAX_ROWS = 8000
BLOCK_ROWS = 256
CLIP = 8.0
THRESHOLD = 0.3

# The class of each byte; pairs of neighbouring classes are counted.
_GROUPS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|",
    b"*", b"%", b"&", b"$", b"#", b"'\"`", b"()[]{}", b"-_", b":;", b"/\\", b"<>=", b"@", b"\t\r\x0b\x0c",
)
CLASSES = len(_GROUPS) + 2
_CLASS_OF = bytes(
    next((n for n, g in enumerate(_GROUPS) if b in g), len(_GROUPS) + (b >= 0x80)) for b in range(256)
)
N_SHAPES = 9
N_FEATURES = CLASSES * CLASSES + N_SHAPES


def features(raw: bytes | None) -> np.ndarray:
    """Shape of a whole text: shares of byte-class pairs, and how much its words and lines repeat."""
    out = np.zeros(N_FEATURES, np.float32)
    if not raw:
        return out
    kind = np.frombuffer(raw.translate(_CLASS_OF), np.uint8).astype(np.int32)
    if len(kind) > 1:
        pairs = np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES)
        out[:CLASSES * CLASSES] = np.sqrt(pairs / (len(kind) - 1))
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    if n:
        counts = Counter(words)
        out[-N_SHAPES:] = (
            np.log1p(n) / 10, len(counts) / n, len(counts) / n ** 0.8, sum(map(eq, words, words[1:])) / n,
            max(counts.values()) / n, len(raw) / n / 10, len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)) / 10, 1.0,
        )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(total: Callable[[Callable], np.ndarray | None], prior: float, rounds: int = 300, rate: float = 0.02, decay: float = 1e-3) -> Model | None:
    """Linear model of least non-negative risk.

    The risk is prior * E_pos[l(f, +)] + max(0, E_unl[l(f, -)] - prior * E_pos[l(f, -)]) with the logistic loss l. Where
    the second part is below 0 the step goes up that part instead, so that no unlabelled row is fitted as negative
    beyond what the prior allows.

    ``total`` adds up a function of all blocks of rows: whether they are positives, the entries of each row, and the
    places and values of the entries.
    """
    n = N_FEATURES
    counts = total(lambda trusted, sizes, at, x: np.array([trusted, not trusted], np.float64) * len(sizes))
    if counts is None or not counts.all():
        return None
    n_pos, n_unl = counts
    rows = n_pos + n_unl
    found = total(lambda trusted, sizes, at, x: np.concatenate([np.bincount(at, x, n), np.bincount(at, minlength=n)]))
    mean = (found[:n] / rows).astype(np.float32)
    square = total(lambda trusted, sizes, at, x: np.bincount(at, np.square(x - mean[at], dtype=np.float64), n))
    square += (rows - found[n:]) * np.square(mean, dtype=np.float64)
    scale = np.maximum(np.sqrt(square / rows), 1e-3).astype(np.float32)
    zero = np.clip(-mean / scale, -CLIP, CLIP)

    def slopes(w: np.ndarray, b: float, flat: bool = False) -> np.ndarray:
        """Of positives and unlabelled rows the mean of l(z, -) and of its derivative s(z) (``flat``: 1) by weights and bias."""
        base = float(zero @ w) + b

        def add(trusted, sizes, at, x):
            x = np.clip((x - mean[at]) / scale[at], -CLIP, CLIP) - zero[at]  # how far from a row of zeros
            z = np.add.reduceat(x * w[at], np.append(0, np.cumsum(sizes)[:-1])).astype(np.float64) + base
            g = np.ones(len(z)) if flat else 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            out = np.zeros((2, n + 2))
            out[int(not trusted)] = np.concatenate([
                [np.logaddexp(0, z).sum()], np.bincount(at, x * np.repeat(g, sizes), n) + zero * g.sum(), [g.sum()]])
            return out.ravel()

        return total(add).reshape(2, n + 2) / counts[:, None]

    w, b = np.zeros(n, np.float32), 0.0
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    ones = slopes(w, b, True)[0]
    for t in range(1, rounds + 1):
        pos, unl = slopes(w, b)
        step = unl[1:] - prior * pos[1:]
        # derivative of l(z, -) is s(z), of l(z, +) is s(z) - 1
        step = -step if unl[0] < prior * pos[0] else step + prior * (pos[1:] - ones[1:])
        step[:-1] += decay * w
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return Model(mean, scale, w, b, prior)


def held_out(id_column: str, folds: int = 5) -> Column:
    """Whether a row belongs to the fold whose labels are never learnt: crc32 of the id as text, mod ``folds``, is 0."""
    return F.pmod(F.crc32(F.coalesce(quoted(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows (all, if fewer), chosen by a hash of the id: the same rows in each run."""
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))


def _blocks(rows: DataFrame) -> DataFrame:
    """Features of the texts without zeros, in blocks of rows; the last one always, so that no row is empty.

    Trusted rows are in blocks of their own and, as any row, among the unlabelled.
    """
    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["trusted", "sizes", "at", "x"]
        pending = {True: [], False: []}

        def block(kind: bool) -> pa.RecordBatch:
            found, pending[kind] = pending[kind], []
            sizes = np.array([len(places) for places, _ in found], np.uint16).tobytes()
            at, x = (b"".join(v[k].tobytes() for v in found) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([kind]), *(pa.array([v], pa.binary()) for v in (sizes, at, x))], names=names)

        for part in parts:
            for text, known in zip(part["text"].to_pylist(), part["trusted"].to_pylist(), strict=True):
                x = features(text)
                places = np.append(np.flatnonzero(x[:-1]), len(x) - 1)
                for kind in (False, True) if known else (False,):
                    pending[kind].append((places.astype(np.uint16), x[places]))
                    if len(pending[kind]) == BLOCK_ROWS:
                        yield block(kind)
        yield from (block(kind) for kind in (False, True) if pending[kind])

    return map_batches(rows.select("text", "trusted"), build, "trusted boolean, sizes binary, at binary, x binary")


def train(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
    max_rows: int = MAX_ROWS, folds: int = 5,
) -> Model | None:
    """Fit on about ``max_rows`` trusted positives and, as unlabelled, every text of the table.

    Positives are documents whose labels are all 1, outside the held-out fold; the class prior is the share of such
    among all labelled documents outside that fold. Without any positive there is no model.

    Features are built once and stored in the shared folder. Each round is an aggregate over all of them; the driver
    gets sums of a fixed size from each task and never a row.
    """
    marks = labels.where(quoted(label).isNotNull() & quoted(id_column).isNotNull() & ~held_out(id_column, folds))
    marks = marks.groupBy(quoted(id_column).alias("id")).agg(F.min(quoted(label)).alias("good"))
    good, labelled = marks.agg(F.coalesce(F.sum((F.col("good") == 1).cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    if not good:
        return None
    prior = min(good / labelled, 0.99)
    rows = documents.select(quoted(id_column).alias("id"), quoted(text).cast("binary").alias("text"))
    trusted = _sample(marks.where("good = 1").select("id"), max_rows)  # about max_rows ids
    rows = rows.join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), "id", "left")

    blocks = materialize(_blocks(rows))
    # a task for each part of a shuffle, however many files the features have: as many sums reach the driver each round
    spark = documents.sparkSession
    blocks = blocks.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def total(change: Callable) -> np.ndarray | None:
        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for part in parts:
                for trusted, *raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    sizes, at, x = (np.frombuffer(v, k) for v, k in zip(raw, (np.uint16, np.uint16, np.float32), strict=True))
                    found = change(trusted, sizes.astype(np.intp), at.astype(np.intp), x)
                    own = found if own is None else own + found
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array([own.astype(np.float64).tobytes()], pa.binary())], names=["sums"])

        found = [np.frombuffer(bytes(r["sums"]), np.float64) for r in map_batches(blocks, add, "sums binary").collect()]
        return np.sum(found, axis=0) if found else None

    return fit(total, prior)


def score_quality(documents: DataFrame, model: Model | None, text: str = "text", column: str = "score") -> DataFrame:
    """``documents`` plus the chance of label 1, from the whole text alone; without a model every score is 1.

    Null and empty texts get the score of a text without any feature. A column of the same name is replaced. One pass,
    no shuffle; the model has a fixed size.
    """
    kept = documents.select(*[quoted(c) for c in documents.columns if c != column])
    at = kept.columns.index(text)
    names = [*kept.columns, column]

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(at).cast(pa.binary()).to_pylist()
            found = model.scores(np.stack([features(x) for x in texts])) if model and texts else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=names)

    return map_batches(kept, score, plus(kept.schema, **{column: DoubleType()}))


def keep_good(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with their own columns."""
    column = new_name(documents, "quality_score")
    scored = score_quality(documents, train(documents, labels, id_column, text), text, column)
    return scored.where(quoted(column) >= threshold).drop(column)
