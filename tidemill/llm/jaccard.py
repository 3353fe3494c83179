"""N-gram Jaccard join: universe partition with a pigeonhole argument, then exact verification.

A document is the set of its distinct word shingles. Two sets of Jaccard similarity at least t that have s elements or
more differ in at most d = s (1 - t) / t elements. Each size band cuts the universe of shingle hashes into segments. If
two sets differ in at most d elements, then of any d + 1 segments they agree in one, and of any (d + 1) / 2 segments
there is one in which they differ by one element at most: one of the two, less one element, equals the other. So it
is enough to index subsets by segment, in some bands with their one-deletion neighbourhoods; a cost model chooses.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemill.llm.components import components
from tidemill.llm.helpers import map_batches, plain_words, quoted
from tidemill.session import materialize

WORD_CACHE = 400_000
_ODD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (finaliser of a counter-based generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered until there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingle_set(raw: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; with fewer words the whole sequence is one."""
    words = plain_words(raw)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    span = min(width, n)
    factors = [pow(_ODD, 2 * j + 3, 1 << 64) | 1 for j in range(span)]
    total = np.full(n - span + 1, span, np.uint64)
    for j, factor in enumerate(factors):
        total += mixed(values[j:n - span + 1 + j] ^ np.uint64(factor)) * np.uint64(factor)
    return np.unique(mixed(total))


def set_print(elements: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set of hashes, signed halves."""
    halves = (elements.sum(dtype=np.uint64), mixed(elements ^ np.uint64(_ODD)).sum(dtype=np.uint64))
    return tuple(int(h.astype(np.int64)) for h in halves)


@dataclass(frozen=True)
class Band:
    """Sizes up to ``high`` and how their universe is cut: ``elastic`` segments are indexed with one-deletions.

    Sets with at most ``slack`` small segments leave keys that stand for fewer than ``least`` elements out of the index.
    """

    number: int
    high: int
    segments: int
    elastic: bool
    slack: int
    least: int


class Bands:
    """Size bands for similarity ``num / den`` and the signatures of a set."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        self.bands: list[Band] = []
        high = 0
        while high < largest:
            high = max(high + 1, high * den * den // (num * num))
            self.bands.append(self._allocate(len(self.bands), high))
        self.highs = [b.high for b in self.bands]

    def differences(self, size: int) -> int:
        """Most elements by which a set of ``size`` and one similar to it differ."""
        return size * (self.den - self.num) // self.num

    def _allocate(self, number: int, high: int) -> Band:
        """Exact segments or segments with one-deletions, whichever costs less.

        The cost counts index rows plus chance meetings on small subsets. An agreement on a subset that chance left
        empty says nothing, so there are ``slack`` more segments than the argument needs, enough for all but very few
        of the sets of the band, the smallest included, to leave such subsets out of the index:

        * Exact segments: of ``d + 1 + slack`` segments at least ``slack + 1`` agree, one more than a set with fewer than
          ``slack`` empty ones needs, and one more: two similar sets agree in at least two indexed segments, so one
          chance meeting makes no candidate.
        * Elastic segments: fewer than ``need`` of ``need + slack`` hold two or more differences, so at least ``slack + 1``
          hold one at most. A set with at most ``slack`` small segments (``least`` elements or fewer) has a larger one
          among them. There the other set has at least ``least`` elements, and so has the subset they share: the
          equal ones, or the larger one less its extra element. Keys of fewer elements are left out.

        Sets with more empty or small segments index all keys: two of these meet in any segment that agrees.
        """
        ratio = self.num / self.den
        d, middle = self.differences(high), max(1.0, high * ratio)
        chance = lambda g, most: sum(math.exp(-g) * g**i / math.factorial(i) for i in range(most + 1))
        half = lambda d: -(-(d + 1) // 2)
        sizes = [max(1.0, high * ratio**k) for k in (0, 0.5, 1, 1.5, 2, 2.5, 3)]  # from two bands below on

        def least_slack(taken, most: int) -> int | None:
            for slack in range(d + 2):
                m = taken(d) + slack
                small = [(taken(self.differences(int(s))) + slack) * chance(s / m, most) for s in sizes]
                if max(x + 4 * math.sqrt(x) for x in small) + 1 <= slack:
                    return slack
            return None

        slack, exact = least_slack(lambda d: d + 1, 0), math.inf
        if slack is not None:
            m = d + 1 + slack
            exact = m + 5 * m * chance(middle / m, 2)
        need, spare, least = half(d), 0, 0
        for most in (2, 1):
            found = least_slack(half, most)
            if found is not None and found <= need:
                spare, least = found, most
                break
        m = need + spare
        if exact <= m + middle + 5 * m * chance(middle / m, 3):
            return Band(number, high, d + 1 + slack, False, slack, 1)
        return Band(number, high, m, True, spare, least)

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """Index keys of a set: those of its own band, and of the next if a similar set may lie there.

        A set takes the first segments only, as many as its own size asks for: two sets that differ in d elements
        agree within the first d + 1 (plus slack), and both take at least those. Two similar sets of different size
        meet in the band of the larger one.
        """
        size = len(elements)
        if not self.differences(size):  # similar sets are equal sets
            return np.empty(0, np.uint64)
        own = int(np.searchsorted(self.highs, size))
        wanted = [self.bands[own]]
        if own + 1 < len(self.bands) and size * self.den > self.highs[own] * self.num:
            wanted.append(self.bands[own + 1])
        found = [self._in_band(elements, b) for b in wanted]
        # the lowest bit marks buckets of elastic bands, in which one meeting counts as much as two
        return np.unique(np.concatenate([(x & ~np.uint64(1)) | np.uint64(b.elastic) for x, b in zip(found, wanted, strict=True)]))

    def _in_band(self, elements: np.ndarray, band: Band) -> np.ndarray:
        d = self.differences(len(elements))
        take = min(band.segments, (-(-(d + 1) // 2) if band.elastic else d + 1) + band.slack)
        salt = np.uint64(pow(_ODD, 2 * band.number + 1, 1 << 64) | 1)
        place = ((elements * salt) >> np.uint64(32)) * np.uint64(band.segments) >> np.uint64(32)
        inside = place < take
        order = np.argsort(place[inside], kind="stable")
        place, values = place[inside][order], mixed(elements[inside][order] ^ salt)
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(place)))
        sums = np.add.reduceat(values, starts) if len(starts) else np.empty(0, np.uint64)
        segments = place[starts]

        def key(total, segment, count):
            with np.errstate(over="ignore"):
                tag = (segment + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
                return mixed(mixed(total + salt) ^ tag)

        empty = take - len(starts)
        if band.elastic:
            least = band.least if empty + int((sizes <= band.least).sum()) <= band.slack else 0
            full, less = sizes >= least, np.repeat(sizes, sizes) > least
            out = [key(sums[full], segments[full], sizes[full]),
                   key((np.repeat(sums, sizes) - values)[less], place[less], np.repeat(sizes, sizes)[less] - 1)]
        else:
            least, out = int(empty < band.slack), [key(sums, segments, sizes)]
        if empty and not least:
            missing = np.setdiff1d(np.arange(take, dtype=np.uint64), segments)
            out.append(key(np.zeros(len(missing), np.uint64), missing, np.zeros(len(missing), np.int64)))
        return np.concatenate(out)


def _keyed(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """``(key, id, text)`` with a unique whole number as key: the id itself where it is one, else a row number."""
    rows = documents.select(quoted(id_column).alias("id"), quoted(text).cast("binary").alias("text"))
    if isinstance(rows.schema["id"].dataType, IntegralType):
        repeats = rows.groupBy("id").count().where("id is null or count > 1").limit(1).count()
        if not repeats:
            return rows.select(F.col("id").cast("bigint").alias("key"), "id", "text")
    return materialize(rows.select(F.monotonically_increasing_id().alias("key"), "id", "text"))


SKETCH = [f"s{i}" for i in range(8)]  # 512 bits
LONG_SKETCH = [f"l{i}" for i in range(32)]  # 2048 bits


def parity_sketch(elements: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` (a power of two), each the parity of the elements on it: two sets differ in at least as many elements as bits.

    The exclusive or of both halves is the sketch of half as many bits.
    """
    at = (mixed(elements ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """``(key, elements)`` of rows ``(key, text)``."""
    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            found = [shingle_set(x, width, hashes).view(np.int64) for x in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["key"], pa.array(found, pa.list_(pa.int64()))], names=["key", "elements"])

    return map_batches(rows.select("key", "text"), build, "key bigint, elements array<bigint>")


def _verified(pairs: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, by exact counts; sets are built for their documents only."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = materialize(_sets(rows.select("key", "text").join(materialize(keys), "key", "left_semi"), width))
    left = sets.select(F.col("key").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("key").alias("b"), F.col("elements").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b")).cast("bigint")
    both = F.size("of_a") + F.size("of_b")
    checked = pairs.join(right, "b").join(left, "a").select("a", "b", common.alias("common"), both.cast("bigint").alias("both"))
    return checked.where(F.col("common") * den >= (F.col("both") - F.col("common")) * num).select("a", "b")


def _near(num: int, den: int, sketch: list[str]) -> Column:
    """Whether two sets, of n elements and of m, with these sketch columns and those with an o before, can be similar enough.

    Similar sets differ in at most (n + m) (den - num) / (den + num) elements, so their sketches in no more bits.
    """
    bits = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"o{s}"))) for s in sketch), F.lit(0))
    return _close("n", "m", num, den) & (bits * (num + den) <= (F.col("n") + F.col("m")) * (den - num))


def _possible(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` that their sizes and sketches do not rule out: first the short sketch, then the wide one."""
    left = marks.select(F.col("key").alias("a"), "n", *SKETCH)
    right = marks.select(F.col("key").alias("b"), F.col("n").alias("m"), *[F.col(s).alias(f"o{s}") for s in SKETCH])
    near = materialize(pairs.join(left, "a").join(right, "b").where(_near(num, den, SKETCH)).select("a", "b", "n", "m"))
    keys = materialize(near.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    wide = materialize(marks.select("key", "wide").join(keys, "key", "left_semi"))
    both = near.join(wide.select(F.col("key").alias("a"), F.col("wide").alias("x")), "a").join(wide.select(F.col("key").alias("b"), F.col("wide").alias("y")), "b")

    def halved(x: str, y: str) -> Column:
        half = F.size(y)
        folded = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) == 2 * half, folded).otherwise(F.col(x))

    differing = F.zip_with(halved("x", "y"), halved("y", "x"), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    bits = F.aggregate(differing, F.lit(0), lambda total, c: total + F.coalesce(c, F.lit(0)))
    return both.where(bits * (num + den) <= (F.col("n") + F.col("m")) * (den - num)).select("a", "b")


def _close(n: str | Column, m: str | Column, num: int, den: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    n, m = (F.col(x) if isinstance(x, str) else x for x in (n, m))
    return F.least(n, m) * den >= F.greatest(n, m) * num


def similar_groups(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10,
) -> DataFrame:
    """``(id, n_shingles, component)``, one row per row of ``documents``; similarity at least ``num / den`` links two.

    ``component`` is the smallest id reachable by links, the own id included. Null and empty texts have no shingles and
    link with nothing. Repeated rows, and rows that share an id, are documents of their own; rows with a null id link
    like others but give no component its name.

    Documents with equal sets are one node. In each index bucket, nodes are compared with the first and the previous
    node; the links found make components. Any two nodes of one bucket that are then still in different components are
    compared as well if they meet often enough, so no link between components can be missed, and no group of similar
    documents is expanded into all its pairs. Broadcasts are left to the optimizer's size check.
    """
    if 2 * num < den or num > den:
        raise ValueError("the similarity must lie between 0.5 and 1")
    rows = _keyed(documents, id_column, text)

    def prints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            found, wide = [], []
            for raw in part["text"].to_pylist():
                elements = shingle_set(raw, width, hashes)
                found.append((len(elements), *set_print(elements), *parity_sketch(elements, 512).tolist(), *parity_sketch(elements, 2048).tolist()))
                wide.append(parity_sketch(elements, max(512, 1 << (2 * len(elements) - 1).bit_length())) if len(elements) else np.empty(0, np.int64))
            columns = zip(*found, strict=True) if found else [[]] * (3 + len(SKETCH) + len(LONG_SKETCH))
            yield pa.RecordBatch.from_arrays(
                [part["key"], part["id"], *(pa.array(c, pa.int64()) for c in columns), pa.array(wide, pa.list_(pa.int64()))],
                names=["key", "id", "n", "f1", "f2", *SKETCH, *LONG_SKETCH, "wide"])

    kind = rows.schema["id"].dataType.simpleString()
    marks = materialize(map_batches(rows, prints, f"key bigint, id {kind}, n bigint, f1 bigint, f2 bigint, {', '.join(f'{s} bigint' for s in SKETCH + LONG_SKETCH)}, wide array<bigint>"))
    nodes = materialize(marks.where("n > 0").groupBy("f1", "f2", "n").agg(
        F.min("key").alias("node"), F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")))
    largest = nodes.agg(F.max("n")).first()[0] or 0
    bands = Bands(num, den, largest)
    copies = materialize(marks.join(nodes.where("copies > 1"), ["f1", "f2", "n"]).where("key <> node").select("key"))

    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            keys, found = [], []
            for key, raw in zip(part["key"].to_pylist(), part["text"].to_pylist(), strict=True):
                own = bands.signatures(shingle_set(raw, width, hashes))
                found.append(own.view(np.int64))
                keys.append(np.full(len(own), key, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(keys))], names=["bucket", "key"])

    unlike = rows.select("key", "text").join(copies, "key", "left_anti")
    entries = map_batches(unlike, index, "bucket bigint, key bigint")
    in_bucket = Window.partitionBy("bucket").orderBy("key")
    live = entries.select(
        "bucket", "key", F.lag("key").over(in_bucket).alias("previous"), F.lead("key").over(in_bucket).alias("following"),
        F.first("key").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)).alias("head"))
    live = materialize(live.where("previous is not null or following is not null").drop("following"))
    met = live.where("previous is not null")
    heads = met.select(F.col("head").alias("a"), F.col("key").alias("b"), "bucket")
    pairs = heads.unionAll(met.where("head <> previous").select(F.col("previous").alias("a"), F.col("key").alias("b"), "bucket"))
    pairs = materialize(_possible(_met_twice(pairs), marks, num, den))
    links = materialize(_verified(pairs, rows, width, num, den))
    roots = materialize(components(links))
    more = _open_pairs(live, roots, marks, num, den).join(pairs, ["a", "b"], "left_anti")
    more = materialize(_possible(more, marks, num, den))
    if more.limit(1).count():
        roots = components(links.unionAll(_verified(more, rows, width, num, den)))
    named = nodes.join(roots.select(F.col("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("first").alias("component"))
    by_print = named.join(names, "root").select("f1", "f2", "n", "component")
    return marks.select("id", "n", "f1", "f2").join(by_print, ["f1", "f2", "n"], "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _met_twice(pairs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that meet in two buckets, or in one of an elastic band."""
    meetings = F.sum(F.lit(1) + F.col("bucket").bitwiseAND(F.lit(1)))
    return pairs.groupBy("a", "b").agg(meetings.alias("meetings")).where("meetings >= 2").select("a", "b")


def _open_pairs(live: DataFrame, roots: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of nodes that share a bucket but no component, and that size and sketch do not rule out."""
    placed = live.select("bucket", "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    placed = placed.withColumn("root", F.coalesce("root", "key"))
    open_buckets = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rest = materialize(placed.join(open_buckets.select("bucket"), "bucket").join(marks.select("key", "n", *LONG_SKETCH), "key"))
    other = rest.select("bucket", F.col("key").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), *[F.col(s).alias(f"o{s}") for s in LONG_SKETCH])
    apart = (F.col("root") != F.col("other")) & (F.col("key") < F.col("b"))
    return _met_twice(rest.join(other, "bucket").where(apart & _near(num, den, LONG_SKETCH)).select(F.col("key").alias("a"), "b", "bucket"))


def keep_one(documents: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The documents that give their group its name, and those linked with nothing; other columns pass through.

    Rows without words stay. Rows that share an id, null too, stay together: all of them if any gives a group its name.
    """
    groups = similar_groups(documents, id_column, text, width, num, den)
    keep = groups.where(quoted(id_column).eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)).select(quoted(id_column).alias("__tm_id")).distinct()
    return documents.join(keep, quoted(id_column).eqNullSafe(F.col("__tm_id")), "left_semi")
