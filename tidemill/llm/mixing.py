"""Mixing sources to target weights: balanced sampling by the cube method."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.helpers import quoted
from tidemill.operators.ordering import dense_ids
from tidemill.session import materialize

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK_ROWS = 4096
LANDING = 12
_EDGE = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``(source, source_size, documents, place, target)`` from rows ``(source, size)``.

    Sources by code point, null last, get the ``weights`` in turn and share all sizes; a target stops at ``most`` times
    its source's size and the excess is shared anew by weight until no target is above. Each round is one aggregate.
    """
    groups = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    order = groups.withColumn("unnamed", F.col("source").isNull())
    placed = dense_ids(order, ["unnamed", "source"], "place", 0).drop("unnamed")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = materialize(placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(share) > F.col("cap")
        n, held, open_weight = rows.agg(
            F.coalesce(F.sum(above.cast("int")), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not open_weight:
            break
        capped, share = n, (total - held) / open_weight
    target = F.least(F.col("cap"), F.col("weight") * F.lit(share))
    return rows.select("source", "source_size", "documents", "place", target.alias("target"))


def flight(chances: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Moves inclusion chances to 0 or 1 so that the expected count and the expected size stay what they are.

    Of any three open units one direction keeps both totals: the null space of the two constraints. A random step to
    either end of it, with odds that keep the expectation, decides at least one unit. At most two units of different
    size stay open. ``land`` decides these as well: ``LANDING`` units wait on the ground, and of all ways to decide
    them and the two that stay open the one is taken that comes nearest to the expected size, then count.
    """
    p = chances.astype(float).copy()
    p[p < _EDGE] = 0.0
    p[p > 1 - _EDGE] = 1.0
    waiting = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))]
    ground = waiting[-LANDING:] if land else []
    waiting = waiting[:len(waiting) - len(ground)][::-1]
    luck = iter(rng.random(len(waiting) + 4).tolist())
    size = sizes.astype(float).tolist()
    chance = p.tolist()

    def move(units: list[int], u: list[float]) -> list[int]:
        up = down = float("inf")
        for i, d in zip(units, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - chance[i]) / d), min(down, chance[i] / d)
            elif d < 0:
                up, down = min(up, chance[i] / -d), min(down, (1 - chance[i]) / -d)
        step = up if next(luck) * (up + down) < down else -down
        left = []
        for i, d in zip(units, u, strict=True):
            value = chance[i] + step * d
            chance[i] = 0.0 if value < _EDGE else 1.0 if value > 1 - _EDGE else value
            if 0 < chance[i] < 1:
                left.append(i)
        if len(left) == len(units):  # rounding: decide the unit nearest to an end
            i = min(left, key=lambda j: min(chance[j], 1 - chance[j]))
            chance[i] = float(round(chance[i]))
            left.remove(i)
        return left

    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) == 3:
            a, b, c = (size[i] for i in held)
            u = [c - b, a - c, b - a]
            largest = max(map(abs, u))
            held = move(held, [x / largest for x in u] if largest else [1.0, -1.0, 0.0])
        elif len(held) == 2 and size[held[0]] == size[held[1]]:
            held = move(held, [1.0, -1.0])
        else:
            break
    if land:
        last = held + ground
        ways = (np.arange(1 << len(last))[:, None] >> np.arange(len(last))) & 1
        off = ways - np.array([chance[i] for i in last])
        words, units = np.abs(off @ np.array([size[i] for i in last])), np.abs(off.sum(1))
        for i, way in zip(last, ways[np.lexsort((units, words))[0]], strict=True):
            chance[i] = float(way)
    return np.array(chance)


def _told_apart(rows: DataFrame) -> DataFrame:
    """The rows, of which equal ones get different ``luck``, so that they fall into different blocks.

    Equal rows are counted before the shuffle, stored, and numbered again from their count at each read. What repeats more often than a block
    holds is dealt out in parts first, so no task writes all copies of a frequent row.
    """
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))
    most = F.lit(BLOCK_ROWS)
    few = counted.where(F.col("n") <= most).withColumn("part", F.lit(0).cast("bigint"))
    many = counted.where(F.col("n") > most).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / most))))
    parts = few.unionByName(many.repartition("luck", "part"))
    start = F.col("part") * most
    copies = parts.withColumn("copy", F.explode(F.sequence(start, F.least(F.col("n"), start + most) - 1)))
    luck = F.when(F.col("copy") == 0, F.col("luck")).otherwise(F.xxhash64("luck", "copy"))
    return copies.withColumn("luck", luck).select(*rows.columns)


def balanced_copies(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, block_rows: int = BLOCK_ROWS, seed: int = 7,
) -> DataFrame:
    """``(id, size, source_size, target, copies, taken)``: how often the mix takes each document.

    A document of a source with target t and size s is taken floor(t / s) times, and once more with chance frac(t / s),
    balanced over the source's words and documents by the cube method. Blocks of a source fly alone; the up to two open
    units of each go on to the next level, until one block a source is left and lands. Hash and seed depend on the rows
    only, so reruns agree. Sizes are words between white space; null texts have size 0; sources of size 0 take nothing.
    Repeated rows are documents of their own.
    """
    size = F.coalesce(F.regexp_count(quoted(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    rows = _told_apart(documents.select(
        quoted(id_column).alias("id"), quoted(source).alias("source"), size.alias("size"),
        F.xxhash64(quoted(id_column), quoted(text)).alias("luck")))
    targets = materialize(source_targets(rows, weights, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(_EDGE))
    units = rows.join(targets.withColumnRenamed("source", "of_source"), rows["source"].eqNullSafe(F.col("of_source")))
    units = units.select("id", "size", "luck", "place", "source_size", "target", whole.cast("bigint").alias("base"),
                         F.greatest(ratio - whole, F.lit(0.0)).alias("chance"))
    schema = units.schema

    def fly(level: int):
        def fly_block(key, block):
            # rows of a block in an order that does not depend on how Spark delivered them
            block = block.sort_by([("luck", "ascending"), ("id", "ascending"), ("size", "ascending")])
            rng = np.random.default_rng([seed, level, key[0].as_py(), key[1].as_py()])
            done = flight(block["chance"].to_numpy(), block["size"].to_numpy(), rng, key[2].as_py() == 1)
            names = [f.name for f in schema]
            return block.select(names).set_column(names.index("chance"), "chance", pa.array(done, pa.float64()))
        return fly_block

    decided, level, largest = [], 0, None
    while True:
        # stored, so that its size is known: few sources are broadcast and the units stay where they are
        counts = materialize(units.groupBy("place").agg(F.count(F.lit(1)).alias("open")))
        largest = counts.agg(F.max("open")).first()[0] or 0
        blocks = F.ceil(F.col("open") / F.lit(block_rows)).cast("int")
        marked = units.join(counts.select("place", blocks.alias("blocks")), "place")
        marked = marked.withColumn("block", F.pmod(F.xxhash64("luck", F.lit(level)), F.col("blocks")))
        # by block, or a shuffle by source alone would be used again and hold a hot source in one task
        flown = materialize(marked.repartition("place", "block").groupBy("place", "block", "blocks").applyInArrow(fly(level), schema))
        still = (F.col("chance") > 0) & (F.col("chance") < 1)
        decided.append(flown.where(~still))
        if largest <= block_rows:
            break
        units, level = flown.where(still), level + 1
    result = decided[0]
    for more in decided[1:]:
        result = result.unionAll(more)
    copies = F.col("base") + F.col("chance").cast("bigint")
    return result.select(F.col("id").alias(id_column), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
