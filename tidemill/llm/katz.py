"""Language-model scores: a word-pair model with Katz backoff, counted and evaluated by Spark.

A token's chance after the word before it is its discounted share of that word's pairs if the pair was seen; else the
backoff weight of the word before times the token's own chance, found the same way: its discounted share of all tokens
if it was seen, else the share that discounting left for unknown words. The first token has no word before it.

Tokens are 64-bit hashes. Everything about a token is kept in the bucket of its hash, so pair counts, single counts and
the places where a document asks for them meet in one task. A token so frequent that it would fill a bucket is spread by
the word before it; there are few such tokens, and every task knows their counts. What depends on the word before
alone splits off from a pair's score: its count belongs to the place where it is itself the token, and its backoff
weight is only needed, and joined, for pairs that were not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.helpers import map_batches, plain_words, quoted, share, shared_value
from tidemill.llm.jaccard import WordHashes, _keyed, mixed
from tidemill.session import materialize

#: Tokens that a task sorts at once, and tokens that a bucket holds on average.
CHUNK_TOKENS = 1_800_000
BUCKET_TOKENS = 4_600_000
#: Counts up to this one are discounted by Good-Turing's estimate.
LARGEST = 5
_MOST_DOCS = 65_535

# No word holds white space, so these stand for no word.
END, START = (int(x) for x in np.array([WordHashes()[b"\n"], WordHashes()[b"\n\n"]], np.uint64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    head = np.array([len(arrays), *(v for a in arrays for v in (ord(a.dtype.kind), a.dtype.itemsize, len(a)))], np.int64)
    body = head.tobytes() + b"".join(a.tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd").compress(body, asbytes=True)


def unpack(raw: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    body = pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    head = np.frombuffer(body, np.int64, 3 * n, 8).reshape(n, 3)
    at, out = 8 * (1 + 3 * n), []
    for kind, width, size in head.tolist():
        out.append(np.frombuffer(body, np.dtype(f"{chr(kind)}{width}"), size, at))
        at += width * size
    return out


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(before ^ np.uint64(0x6A09E667F3BCC909)) + token)


def tokens(raw: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words of a text, and one for its end."""
    words = plain_words(raw)
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def good_turing(kinds: np.ndarray, largest: int = LARGEST) -> np.ndarray:
    """Discount factors of the counts 1 to ``largest`` from how many kinds have each count (``kinds[r]``, up to one more).

    Katz's factors: Good-Turing's estimate, scaled so that only these counts lose anything and all that once-seen kinds
    stand for becomes free. Where the estimates are no proper discounts, as in small tables, each count loses a half.
    """
    r = np.arange(1, largest + 1)
    n = kinds[1:largest + 2].astype(np.float64)
    if n.all():
        last = (largest + 1) * n[largest] / n[0]
        factors = ((r + 1) * n[1:] / n[:-1] / r - last) / (1 - last) if last != 1 else np.zeros(largest)
        if (factors > 0).all() and (factors < 1).all():
            return factors
    return 1 - 0.5 / r


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Counts after the discount. Larger ones lose as much as the largest that Good-Turing covers, so that every word
    leaves something for pairs not seen."""
    largest = len(factors)
    small = np.minimum(counts, largest).astype(np.intp)
    return np.where(counts <= largest, counts * np.append(0.0, factors)[small], counts - largest * (1 - factors[-1]))


@dataclass
class Model:
    """What the driver knows of a fitted model; the rest are the tables ``words``, ``pairs`` and ``weights``.

    ``words``: (token, n). ``pairs``: per bucket its tokens, their counts and the counts of their pairs, packed.
    ``weights``: (before, weight), the logarithm of the backoff weight times the count of the word before.
    """

    total: int
    kinds: int
    word_factors: np.ndarray
    pair_factors: np.ndarray
    unknown: float
    buckets: int
    frequent: tuple[np.ndarray, np.ndarray]
    words: DataFrame
    pairs: DataFrame
    weights: DataFrame | None


def _bucket(before: np.ndarray, token: np.ndarray, buckets: int, frequent: np.ndarray) -> np.ndarray:
    spread = np.where(np.isin(token, frequent), mixed(before), np.uint64(0))
    return (mixed(token + spread) % np.uint64(buckets)).astype(np.int32)


def _chunks(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Keys and tokens of whole documents, about ``most`` tokens at a time; a longer document comes alone."""
    hashes, keys, found, size = WordHashes(), [], [], 0
    for part in parts:
        for key, raw in zip(part["key"].to_pylist(), part["text"].to_pylist(), strict=True):
            own = tokens(raw, hashes)
            if keys and (size + len(own) > most or len(keys) == _MOST_DOCS):
                yield keys, found
                keys, found, size = [], [], 0
            keys.append(key)
            found.append(own)
            size += len(own)
    if keys:
        yield keys, found
    pa.default_memory_pool().release_unused()


def _postings(found: list[np.ndarray], buckets: int, frequent: np.ndarray, by_document: bool):
    """Bucket, token, word before, document and times of every different pair (by document), in this order.

    Empties ``found``. Tokens go by their rank in the chunk, so that rank, rank of the word before and document make
    one number to sort by: fewer than 2**23 tokens and 2**16 documents, or one document, stay below 2**64.
    """
    docs, sizes = np.uint64(len(found) if by_document else 1), np.array([len(f) for f in found])
    token = np.concatenate(found)
    found.clear()
    names, rank = np.unique(token, return_inverse=True)
    del token
    rank, most = rank.astype(np.uint64), np.uint64(len(names) + 1)
    key = rank * most
    key[1:] += rank[:-1]
    starts = np.append(0, np.cumsum(sizes)[:-1])
    key[starts] = rank[starts] * most + most - np.uint64(1)
    del rank
    if by_document:
        key = key * docs + np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key.sort()
    at = _starts(key)
    times, key = _runs(at, len(key)), key[at]
    key, doc = np.divmod(key, docs) if by_document else (key, np.zeros(len(key), np.uint64))
    rank, before = np.divmod(key, most)
    token, before, doc = names[rank], np.append(names, np.uint64(START))[before], doc.astype(np.uint16)
    bucket = _bucket(before, token, buckets, frequent)
    if buckets == 1:
        return bucket, token, before, doc, times
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 65_536 else bucket, kind="stable")
    return tuple(x[order] for x in (bucket, token, before, doc, times))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _runs(starts: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.append(starts, size)).astype(np.uint32)


def _pack_pairs(token: np.ndarray, before: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs sorted by token, with a number each: every word before is written once."""
    at = _starts(token)
    names, index = np.unique(before, return_inverse=True)
    return pack(token[at], _runs(at, len(token)), names, index.astype(np.uint16 if len(names) <= 65_536 else np.uint32), n)


def _unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    token, runs, names, index, n = unpack(raw)
    return np.repeat(token, runs), names[index], n


def count_words(rows: DataFrame) -> DataFrame:
    """``(token, n)`` over all texts of rows ``(key, text)``; tasks add up before the shuffle."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _chunks(parts, CHUNK_TOKENS):
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return map_batches(rows, count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _count_kinds(column: str, largest: int = LARGEST) -> list[Column]:
    return [F.count(F.when(F.col(column) == r, 1)).alias(f"k{r}") for r in range(1, largest + 2)]


def train(rows: DataFrame) -> Model:
    """The model of the texts of rows ``(key, text)``; every count covers all of them.

    Its tables live in the shared folder, pair counts in as many rows as there are buckets.
    """
    spark = rows.sparkSession
    words = materialize(count_words(rows))
    total, kinds, *few = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), *_count_kinds("n")).first()
    word_factors = good_turing(np.array([0, *few]))
    buckets = max(1, -(-total // BUCKET_TOKENS))
    # at most four to a bucket
    top = words.where(F.col("n") * 4 * buckets >= max(total, 1)).orderBy("token").toPandas() if buckets > 1 else None
    frequent = (top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)) if top is not None else (np.empty(0, np.uint64), np.empty(0, np.int64))
    at = np.argsort(frequent[0])
    frequent = (frequent[0][at], frequent[1][at])
    largest = len(word_factors)
    few_lost = F.element_at(F.array(*[F.lit(float(1 - f)) for f in word_factors]), F.least("n", F.lit(largest)).cast("int")) * F.col("n")
    lost = F.when(F.col("n") <= largest, few_lost).otherwise(F.lit(float(largest * (1 - word_factors[-1]))))
    free = words.agg(F.sum(lost)).first()[0] or 0.0
    unknown = free / total if total else 1.0
    shared = share(spark, frequent)

    def own_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared_value(shared)[0]
        for part in parts:
            token, n = (part[c].to_numpy() for c in ("token", "n"))
            token = token.view(np.uint64)
            bucket = _bucket(token, token, buckets, np.empty(0, np.uint64))
            rare = ~np.isin(token, often)
            order = np.argsort(bucket[rare], kind="stable")
            bucket, token, n = bucket[rare][order], token[rare][order], n[rare][order]
            at = _starts(bucket)
            if len(at):
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[at]), pa.array([pack(t, c) for t, c in zip(np.split(token, at[1:]), np.split(n, at[1:]), strict=True)], pa.binary()),
                    pa.array(np.zeros(len(at), bool))], names=["bucket", "packed", "paired"])

    def own_pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared_value(shared)[0]
        for _, found in _chunks(parts, CHUNK_TOKENS):
            bucket, token, before, _, n = _postings(found, buckets, often, False)
            kept = before != np.uint64(START)
            bucket, token, before, n = bucket[kept], token[kept], before[kept], n[kept]
            at = _starts(bucket)
            if len(at):
                cut = [np.split(x, at[1:]) for x in (token, before, n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[at]), pa.array([_pack_pairs(*x) for x in zip(*cut, strict=True)], pa.binary()), pa.array(np.ones(len(at), bool))],
                    names=["bucket", "packed", "paired"])

    layout = "bucket int, packed binary, paired boolean"
    parts = map_batches(words, own_words, layout)
    parts = parts.unionAll(map_batches(rows, own_pairs, layout))

    def add_up(group: pa.Table) -> pa.Table:
        singles, pairs = [], []
        for raw, paired in zip(group["packed"].to_pylist(), group["paired"].to_pylist(), strict=True):
            (pairs if paired else singles).append(_unpack_pairs(raw) if paired else unpack(raw))
        empty = np.empty(0, np.uint64)
        token, n = (np.concatenate(x) for x in zip(*singles, strict=True)) if singles else (empty, np.empty(0, np.int64))
        order = np.argsort(token)
        later, before, count = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (empty, empty, np.empty(0, np.uint32))
        pairs.clear()
        key = pair_key(before, later)
        where = np.argsort(key)
        at = _starts(key[where])
        count = np.add.reduceat(count[where], at, dtype=np.int64) if len(at) else np.empty(0, np.int64)
        where = where[at]
        later, before = later[where], before[where]
        del key, where, at
        by_token = np.argsort(later)
        count = count.astype(np.uint32) if count.max(initial=0) < 2**32 else count
        few = np.bincount(np.minimum(count, LARGEST + 2), minlength=LARGEST + 3)[1:LARGEST + 2]
        return pa.table({
            "bucket": group["bucket"].slice(0, 1), "words": pa.array([pack(token[order], n[order])], pa.binary()),
            "pairs": pa.array([_pack_pairs(later[by_token], before[by_token], count[by_token])], pa.binary()), "few": pa.array([few.tolist()], pa.list_(pa.int64()))})

    pairs = materialize(parts.groupBy("bucket").applyInArrow(add_up, "bucket int, words binary, pairs binary, few array<bigint>"))
    few = pairs.agg(*[F.coalesce(F.sum(F.col("few")[r]), F.lit(0)) for r in range(LARGEST + 1)]).first()
    model = Model(total, kinds, word_factors, good_turing(np.array([0, *few])), unknown, buckets, frequent, words, pairs, None)
    model.weights = materialize(_backoff_weights(model))
    return model


class _Counts:
    """How often the training texts hold a token: a bucket's own counts and those of the frequent tokens."""

    def __init__(self, own: tuple[np.ndarray, np.ndarray], frequent: tuple[np.ndarray, np.ndarray]):
        self.tables = [t for t in (own, frequent) if len(t[0])]

    def of(self, token: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token), np.int64)
        for known, n in self.tables:
            at = np.minimum(np.searchsorted(known, token), len(known) - 1)
            out += np.where(known[at] == token, n[at], 0)
        return out


def _chances(counts: np.ndarray, factors: np.ndarray, total: int, unknown: float) -> np.ndarray:
    """Chance of a token by itself."""
    return np.where(counts > 0, discounted(counts, factors) / max(total, 1), unknown)


def _backoff_weights(model: Model) -> DataFrame:
    """``(before, weight)``: log10 of what the seen pairs of a word leave free over the chance of all that did not follow it.

    Divided by the word's count, the weight makes the chances after it add up to 1 over all known tokens and the
    unknown one. Sums of each bucket are added up by word, so a word that stands before very many others is no hot key.
    """
    shared = share(model.pairs.sparkSession, model.frequent)
    word_factors, pair_factors, total, unknown = model.word_factors, model.pair_factors, model.total, model.unknown

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared_value(shared)
        for part in parts:
            for words, pairs in zip(part["words"].to_pylist(), part["pairs"].to_pylist(), strict=True):
                token, runs, names, index, n = unpack(pairs)
                chance = np.repeat(_chances(_Counts(unpack(words), frequent).of(token), word_factors, total, unknown), runs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(names.view(np.int64)), pa.array(np.bincount(index, n - discounted(n, pair_factors), len(names))),
                    pa.array(np.bincount(index, chance, len(names)))], names=["before", "free", "taken"])

    sums = map_batches(model.pairs.select("words", "pairs"), add, "before bigint, free double, taken double")
    sums = sums.groupBy("before").agg(F.sum("free").alias("free"), F.sum("taken").alias("taken"))
    # the unknown token never follows, so at least its chance is left
    return sums.select("before", F.log10(F.col("free") / F.greatest(1 - F.col("taken"), F.lit(unknown))).alias("weight"))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``(key, n_tokens, n_known, base_score, score)`` for each row ``(key, text)``; keys must differ.

    Each task sends what its documents ask for, sorted and packed, to the buckets, where all counts of a token are. A
    bucket gives each document a sum over its tokens, and the pairs it never saw, whose words before then meet their
    backoff weights.
    """
    buckets, total, kinds, unknown = model.buckets, model.total, model.kinds, model.unknown
    word_factors, pair_factors = model.word_factors, model.pair_factors
    shared = share(rows.sparkSession, model.frequent)

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared_value(shared)[0]
        for keys, found in _chunks(parts, CHUNK_TOKENS):
            keys = np.array(keys, np.int64)
            bucket, token, before, doc, times = _postings(found, buckets, often, True)
            pair = np.zeros(len(token), bool)
            pair[_starts(bucket, token, before)] = True
            edges = np.append(_starts(bucket), len(bucket))
            for i, k in zip(edges[:-1], edges[1:], strict=True):
                first = np.flatnonzero(pair[i:k])
                present, own = np.unique(doc[i:k], return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[i:i + 1]), pa.array([True]), pa.array([pack(keys[present], own.astype(np.uint16), times[i:k])], pa.binary()),
                    pa.array([_pack_pairs(token[i:k][first], before[i:k][first], _runs(first, k - i))], pa.binary())],
                    names=["bucket", "asks", "a", "b"])

    layout = "bucket int, asks boolean, a binary, b binary"
    known = model.pairs.select("bucket", F.lit(False).alias("asks"), F.col("words").alias("a"), F.col("pairs").alias("b"))
    base = total + 0.5 * (kinds + 1)

    def answer(group: pa.Table) -> pa.Table:
        frequent = shared_value(shared)
        empty = np.empty(0, np.uint64)
        own, pair, seen = (empty, np.empty(0, np.int64)), empty, np.empty(0, np.int64)
        asks = group["asks"].to_pylist()
        for i in (i for i, a in enumerate(asks) if not a):
            own = tuple(unpack(group["a"][i].as_py()))
            token, before, n = _unpack_pairs(group["b"][i].as_py())
            pair = pair_key(before, token)
            order = np.argsort(pair)
            pair, seen = pair[order], n[order]
            del token, before, n, order
        counts, pairs = _Counts(own, frequent), _Counts((pair, seen), (empty, empty))
        out = []
        for i in (i for i, a in enumerate(asks) if a):
            keys, doc, times = unpack(group["a"][i].as_py())
            token, before, places = _unpack_pairs(group["b"][i].as_py())
            single, both = counts.of(token), pairs.of(pair_key(before, token))
            both[before == np.uint64(START)] = 0
            chance = np.log10(_chances(single, word_factors, total, unknown))
            gain = np.where(both > 0, np.log10(np.maximum(discounted(both, pair_factors), 1e-300)), chance)
            # as a word before: the share of its pairs is one of its count
            gain -= np.where((single > 0) & (token != np.uint64(END)), np.log10(np.maximum(single, 1)), 0.0)
            missing = np.repeat((both == 0) & (before != np.uint64(START)), places)
            of = lambda x: np.bincount(doc, np.repeat(x, places) * times, len(keys))
            n, m = len(keys), int(missing.sum())
            out.append(pa.table({
                "key": np.concatenate([keys, keys[doc[missing]]]), "before": pa.array(np.append(np.zeros(n, np.int64), np.repeat(before, places)[missing].view(np.int64)), mask=np.append(np.ones(n, bool), np.zeros(m, bool))),
                "n": np.append(np.bincount(doc, times, n).astype(np.int64), times[missing].astype(np.int64)),
                "known": np.append(of((single > 0).astype(np.float64)).astype(np.int64), np.zeros(m, np.int64)),
                "base": np.append(of(np.log10((single + 0.5) / base)), np.zeros(m)), "gain": np.append(of(gain), np.zeros(m))}))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], k) for c, k in (
            ("key", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64()))})

    asked = map_batches(rows.select("key", "text"), ask, layout).unionAll(known)
    found = materialize(asked.groupBy("bucket").applyInArrow(answer, "key bigint, before bigint, n bigint, known bigint, base double, gain double"))
    unseen = found.where("before is not null").join(model.weights, "before").select(
        "key", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("known"), F.lit(0.0).alias("base"), (F.col("n") * F.col("weight")).alias("gain"))
    sums = found.where("before is null").select("key", "n", "known", "base", "gain").unionAll(unseen)
    return sums.groupBy("key").agg(
        F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("gain").alias("score"))


def in_fold(id_column: str, fold: int, folds: int = 5) -> Column:
    """Whether crc32 of the id as text, mod ``folds``, is ``fold``; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(quoted(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def language_scores(documents: DataFrame, id_column: str = "doc_id", text: str = "text", fold: int = 1, folds: int = 5) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``documents``.

    The model learns from the documents outside the fold and scores all. ``score`` is the log10 chance of the whole
    text and its end, ``base_score`` that of its tokens by smoothed single counts, ``n_known`` how many of its tokens
    the training texts hold. Null and empty texts consist of an end. Repeated rows, and rows that share an id, are
    documents of their own. Without any training text every token is the unknown one, of chance 1. An empty table
    gives no rows.
    """
    rows = _keyed(documents, id_column, text)
    model = train(rows.where(~in_fold("id", fold, folds)).select("key", "text"))
    found = rows.select("key", "id").join(score(rows, model), "key")
    return found.select(
        F.col("id").alias(id_column), in_fold("id", fold, folds).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"),
        "base_score", "score")
