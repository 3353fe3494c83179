"""Katz backoff against a plain model of dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_llm_operators import ODD, docs
from tidemill.llm import katz, queries


def plain_model(texts):
    """Chances by dictionaries: of a token alone, and of a token after another."""
    singles, pairs, after = Counter(), Counter(), {}
    for t in texts:
        words = [*words_of(t), None]
        singles.update(words)
        pairs.update(zip(words, words[1:], strict=False))
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    total = sum(singles.values())

    def factors(counts):
        n = [sum(1 for c in counts if c == r) for r in range(8)]
        if all(n[1:7]):
            last = 6 * n[6] / n[1]
            found = [((r + 1) * n[r + 1] / n[r] / r - last) / (1 - last) for r in range(1, 6)]
            if all(0 < f < 1 for f in found):
                return found
        return [1 - 0.5 / r for r in range(1, 6)]

    def less(c, f):
        return c * f[c - 1] if c <= 5 else c - 5 * (1 - f[4])

    f1, f2 = factors(singles.values()), factors(pairs.values())
    unknown = sum(c - less(c, f1) for c in singles.values()) / total if total else 1.0

    def alone(w):
        return less(singles[w], f1) / total if w in singles else unknown

    def chance(a, b):
        if a not in after:
            return alone(b)
        if (a, b) in pairs:
            return less(pairs[a, b], f2) / singles[a]
        free = 1 - sum(less(pairs[a, w], f2) for w in after[a]) / singles[a]
        return free / (1 - sum(alone(w) for w in after[a])) * alone(b)

    return singles, total, alone, chance


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def check(rows, got):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    singles, total, alone, chance = plain_model([t for i, t, _ in rows if fold(i) != 1])
    wanted = []
    for i, t, _ in rows:
        words = [*words_of(t), None]
        score = math.log10(alone(words[0])) + sum(math.log10(chance(a, b)) for a, b in zip(words, words[1:], strict=False))
        base = sum(math.log10((singles[w] + 0.5) / (total + 0.5 * (len(singles) + 1))) for w in words)
        wanted.append((str(i), fold(i) == 1, len(words), sum(w in singles for w in words), total, base, score))
    found = sorted((str(r[0]), *r[1:]) for r in got)
    assert len(found) == len(wanted)
    for a, b in zip(found, sorted(wanted), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return chance, singles


def small(spark, folder="/root/testdata/sf0.001"):
    found = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()
    return [tuple(r) for r in found]


def test_against_plain_model(spark):
    rows = small(spark)
    chance, singles = check(rows, queries.op12_lm_scoring(spark, "/root/testdata/sf0.001").collect())
    for before in ("the", "of", "never seen", next(iter(singles))):
        assert sum(chance(before, w) for w in [*singles, "no such word"]) == pytest.approx(1)


def test_buckets_and_frequent_tokens(spark, monkeypatch):
    rows = small(spark)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 2000)
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 1500)
    d = docs(spark, rows).repartition(5)
    model = katz.train(katz._keyed(d, "doc_id", "text").select("key", "text"))
    assert model.buckets > 10 and 0 < len(model.frequent[0]) <= 4 * model.buckets
    check(rows, katz.language_scores(d).collect())


def test_odd_rows(spark):
    check(ODD, katz.language_scores(docs(spark, ODD)).collect())
    assert katz.language_scores(docs(spark, [])).count() == 0


def test_nothing_to_learn_from(spark):
    own = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = katz.language_scores(docs(spark, [(own, "a b", "s")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_discounts():
    factors = katz.good_turing(np.array([0, 1000, 400, 220, 140, 100, 75]))
    assert ((0 < factors) & (factors < 1)).all()
    lost = sum(r * n * (1 - f) for r, n, f in zip(range(1, 6), (1000, 400, 220, 140, 100), factors, strict=True))
    assert lost == pytest.approx(1000)  # all that stands for pairs seen once
    assert katz.good_turing(np.array([0, 1, 0, 0, 0, 0, 0])).tolist() == [1 - 0.5 / r for r in range(1, 6)]
    assert katz.discounted(np.array([0, 1, 9]), np.array([0.5, 0.75]))[1:].tolist() == [0.5, 8.5]


def test_pack():
    arrays = [np.array([1, 2], np.uint64), np.empty(0, np.uint16), np.array([1.5])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(katz.unpack(katz.pack(*arrays)), arrays, strict=True))
