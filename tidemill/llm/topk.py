"""Exact top-k by inner product: the threshold algorithm over sorted lists per dimension, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.helpers import quoted
from tidemill.session import materialize

BLOCK_ROWS = 8192
QUERY_ROWS = 2048


def integer_vectors(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """``(id, v, copies)`` with components floor(scale * x), one row per different id and vector; unusable ones are left out.

    Null ids, null vectors and vectors with a null or non-finite component take no part.
    """
    x = quoted(vector).cast("array<double>")
    whole = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("bigint"))
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(quoted(id_column).isNotNull() & quoted(vector).isNotNull() & usable)
    rows = rows.select(quoted(id_column).cast("bigint").alias("id"), whole.alias("v"))
    return rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))


class SortedLists:
    """The vectors of a block, with one list per dimension sorted by component."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, copies: np.ndarray):
        self.ids, self.matrix, self.copies = ids, matrix, copies
        self.order = np.argsort(matrix, axis=0, kind="stable")
        self.values = np.take_along_axis(matrix, self.order, axis=0)

    def search(self, query: np.ndarray, own: int, k: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best ``(ids, scores)``, ties to the smaller id, without one copy of the query's own row.

        Each list is read from its better end for the sign of the query's component. Every row met is scored in full.
        No row still unmet can score more than the sum over the lists at the present depth, so the search ends when
        that bound is below the k-th score, or below ``least``, the k-th score of another block; with an equal bound an
        unmet tie may win, so it goes on.
        """
        copies = self.copies
        mine = np.flatnonzero(self.ids == own)
        mine = mine[(self.matrix[mine] == query).all(axis=1)] if len(mine) else mine
        if len(mine):
            copies = copies.copy()
            copies[mine] -= 1
        rows, _ = self.matrix.shape
        met = np.zeros(rows, bool)
        met[copies == 0] = True
        used = np.flatnonzero(query)
        down = used[query[used] > 0]
        up = used[query[used] < 0]
        at = np.empty(0, np.int64)
        scores = np.empty(0, self.matrix.dtype)
        depth, step = 0, 16
        while depth < rows:
            to = min(rows, depth + step)
            near = np.concatenate([self.order[rows - to:rows - depth, down].ravel(), self.order[depth:to, up].ravel()])
            if not len(used):
                near, to = np.arange(rows), rows
            fresh = np.unique(near[~met[near]])
            met[fresh] = True
            at = np.concatenate([at, fresh])
            scores = np.concatenate([scores, self.matrix[fresh] @ query])
            if len(at) > k:
                best = np.lexsort((self.ids[at], -scores))[:k]
                at, scores = at[best], scores[best]
            bound = (self.values[rows - to, down] * query[down]).sum() + (self.values[to - 1, up] * query[up]).sum()
            if len(at) >= k and scores.min() > bound or least is not None and bound < least:
                break
            depth, step = to, step * 2
        best = np.lexsort((self.ids[at], -scores))[:k]
        times = np.minimum(copies[at[best]], k)
        return np.repeat(self.ids[at[best]], times)[:k], np.repeat(scores[best], times)[:k]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row its k highest integer inner products among the other rows.

    Ties go to the smaller id; with fewer than k candidates all are returned. Every row but the query's own is a
    candidate, also one that repeats an id; a query's own row is one with its id and its integer vector. Each query row
    gets ranks of its own, so two query rows of one id give two rows per rank. Vectors of different length are compared
    with zeros in place of the missing components.

    Both sides are cut into blocks of bounded size by a hash; each pair of a query block and a vector block is one
    task's work, and the k best of the blocks meet in a window per query. The k-th score in the first block bounds the
    search of all others. Scores are exact: products are summed in 64-bit floats while all sums stay below 2**53, else
    as integers.
    """
    found = materialize(integer_vectors(vectors, id_column, vector, scale))
    asked = integer_vectors(queries, id_column, vector, scale)
    asked = materialize(asked.select("id", "v", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(F.monotonically_increasing_id().alias("ask"), "id", "v"))
    blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((found, block_rows), (asked, query_rows)))
    mine = found.select("id", "v", "copies", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    theirs = asked.select("ask", "id", "v", F.pmod(F.xxhash64("ask"), F.lit(query_blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("b"))

    def search(left, right):
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            both = [x["v"].to_pylist() for x in (left, right)]
            wide = max(len(v) for side in both for v in side)
            ours, asks = (np.array([v + [0] * (wide - len(v)) for v in side], np.int64).reshape(len(side), wide) for side in both)
            largest = float(np.abs(ours).max(initial=0)) * float(np.abs(asks).max(initial=0)) * max(1, wide)
            kind = np.float64 if largest < 2**53 else object
            ids = left["id"].to_numpy()
            by_id = np.argsort(ids, kind="stable")
            lists = SortedLists(ids[by_id], ours[by_id].astype(kind), left["copies"].to_numpy()[by_id])
            for ask, own, least, query in zip(*(right[c].to_pylist() for c in ("ask", "id", "least")), asks.astype(kind), strict=True):
                near, scores = lists.search(query, own, k, least)
                out[0].extend([ask] * len(near))
                out[1].extend([own] * len(near))
                out[2].extend(int(x) for x in near)
                out[3].extend(int(x) for x in scores)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["ask", "query_id", "vec_id", "score"])

    def meet(ours: DataFrame, asks: DataFrame) -> DataFrame:
        return ours.groupBy("q", "b").cogroup(asks.groupBy("q", "b")).applyInArrow(search, "ask bigint, query_id bigint, vec_id bigint, score bigint")

    near = meet(mine.where("b = 0"), theirs.where("b = 0").withColumn("least", F.lit(None).cast("bigint")))
    if blocks > 1:
        near = materialize(near)
        bounds = near.groupBy("ask").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        near = near.unionAll(meet(mine.where("b > 0"), theirs.where("b > 0").join(bounds.select("ask", "least"), "ask", "left")))
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
