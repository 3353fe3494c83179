"""Importance resampling and spelling variants against brute force, and on odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import ODD, docs
from tidemill.llm.resampling import bucket_gains, cutoff, feature_buckets, resample
from tidemill.llm.spelling import count_words, near_in_group, near_words, spelling_groups

EMPTY = [(1, None, "a"), (2, "", "b"), (3, " \n", "c")]


def test_feature_buckets():
    for n in range(5):
        words = [bytes([97 + i]) * (i + 1) for i in range(n)]
        wanted = [zlib.crc32(b" ".join(words[i:i + k])) % 10000 for k in (1, 2, 3) for i in range(n - k + 1)]
        assert sorted(feature_buckets(words).tolist()) == sorted(wanted)


def test_gains():
    gains = bucket_gains(np.array([5, 0, 1]), np.array([0, 7, 1]))
    assert gains.tolist() == [int(np.floor(1000 * np.log((t + 1) * 9.0 / ((s + 1) * 11.0)))) for s, t in ((5, 0), (0, 7), (1, 1))]


@pytest.mark.parametrize("case", ["spread", "ties", "one", "skewed"])
def test_cutoff(spark, case):
    rng = random.Random(case)
    score = {"spread": lambda: rng.randint(-10**9, 10**9), "ties": lambda: rng.randint(0, 3), "one": lambda: 7,
             "skewed": lambda: rng.choice([0, 0, 0, rng.randint(0, 10**12)])}[case]
    rows = [(rng.choice([None, *range(900)]), score(), rng.randint(1, 3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, score bigint, n_features bigint").repartition(7)
    ordered = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    for share_of, margin in (((5, 100), 0.0005), ((1, 2), 0.2), ((1, 1), 0.001), ((1, 3000), 0.0005)):
        last, drawn = cutoff(df, share_of, margin)
        assert drawn == 3000 * share_of[0] // share_of[1]
        assert (last["id"], last["score"], last["n_features"]) == ordered[drawn - 1]
    assert cutoff(df, (1, 4000))[1] == 0


def test_resample_repeats_and_names(spark):
    rows = [(i % 40, "w" * (i % 3 + 1) + " " + "x y z " * 7, "a") for i in range(400)] + ODD
    d = docs(spark, rows)
    target = spark.createDataFrame([("x y z",), (None,)], "text string")
    got = resample(d, target, share_of=(1, 4)).collect()
    assert len(got) == len(rows)
    able = 400 + 1
    assert sorted(r.rank for r in got if r.rank) == list(range(1, able // 4 + 1))
    drawn = [r for r in got if r.rank]
    drawn.sort(key=lambda r: r.rank)
    assert [(-r.score, r.doc_id) for r in drawn] == sorted((-r.score, r.doc_id) for r in drawn)
    assert all(r.weight == 0 and r.n_features == 0 for r in got if r.doc_id in (1, 2, 5) and r.n_features < 10 and r.rank is None and r.weight == 0)


def test_resample_without_draw(spark):
    target = spark.createDataFrame([], "text string")
    for rows in ([], EMPTY):
        got = resample(docs(spark, rows), target).collect()
        assert len(got) == len(rows) and all((r.n_features, r.weight, r.rank) == (0, 0, None) for r in got)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_near_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(500)} | {"a" * n for n in range(1, 9)} | {"zzzzz"}
    rows = [(w, rng.randint(1, 4)) for w in sorted(words)]
    wanted = {}
    for w, _ in rows:
        near = [(-n, v) for v, n in rows if one_edit(w, v)]
        if near:
            wanted[w] = (len(near), min(near)[1], -min(near)[0])
    df = spark.createDataFrame(rows, "word string, n bigint")
    for block in (4096, 5):
        assert {r.word: (r.n_near, r.near, r.near_n) for r in near_words(df, block).collect()} == wanted


def test_bits_of_all_edits():
    words = ["abcde", "abcdx", "abde", "abcdee", "babcde", "abce", "xbcde"]
    for tail in (False, True):
        found = {(words[i], words[k]) for length in (5, 6) for i, bits in near_in_group(words, words, length, (length - 1) // 2, tail) for k in range(len(words)) if bits >> k & 1}
        assert all(one_edit(a, b) and (a[:2] == b[:2]) != tail for a, b in found)
        assert all((b, a) in found for a, b in found)


def test_spelling_groups(spark):
    texts = ["Colour colour COLOUR colour colour colour colour colour", "color color color color", "colr colour's colr", "colo", None, "", "naïve naïve naïve naïves",
             "word " * 5 + "x" * 50000, "coluor 1a2 coluor,coluor", "CAFÉS cafÉs cafés cafÉs"]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(3, "naïves naïves", "b"), (None, "naïve", "b")]
    d = docs(spark, rows)
    counts = {}
    for i, t, _ in rows:
        word = ""
        for c in (t or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                word += c.lower() if c <= "Z" else c
                continue
            if word:
                h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                if h % 97 == 0:
                    word = word[:h % len(word)] + word[h % len(word) + 1:]
                counts[word] = counts.get(word, 0) + 1
            word = ""
    assert {r.word: r.n for r in count_words(d).collect()} == {w: n for w, n in counts.items() if len(w) >= 5}
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = {r.word: r for r in spelling_groups(d).collect()}
    assert set(got) == set(kept)
    for word, r in got.items():
        near = sorted((-n, v) for v, n in kept.items() if one_edit(word, v))
        form = near[0][1] if near and -near[0][0] >= 2 * kept[word] else None
        assert (r.n, r.n_near, r.form, r.form_n) == (kept[word], len(near), form, kept.get(form))
        assert r.root == (got[form].root if form else word)
    assert spelling_groups(docs(spark, [])).count() == spelling_groups(docs(spark, EMPTY)).count() == 0


def test_long_chain(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc"]
    text = " ".join(w for i, w in enumerate(words) for _ in range(3 * 2**i))
    ids = [i for i in range(2000) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in words)]
    got = {r.word: r.root for r in spelling_groups(docs(spark, [(ids[0], text, "a")])).collect()}
    assert got == dict.fromkeys(words, "bbbcc")


def test_ids_of_text(spark):
    d = docs(spark, [(1, "alpha " * 30, "a"), (2, "beta " * 30, "b")]).withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    got = resample(d, d, share_of=(1, 2)).collect()
    assert {r.doc_id for r in got} == {"k1", "k2"} and sorted(r.rank or 0 for r in got) == [0, 1]
