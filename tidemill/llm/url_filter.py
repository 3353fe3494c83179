"""URL filters: unigram Viterbi segmentation of hosts, then multinomial naive Bayes over host and path words."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from tidemill.llm.helpers import map_batches, plus, quoted, share, shared_value

# Rules of the contract as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Words that make a URL an example of the class to block, and ordinary words of names.
BLOCKED_WORDS = (
    "adult", "ads", "adserver", "advert", "bet", "bets", "betting", "casino", "cialis", "clickbait", "escort", "gambling",
    "jackpot", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "tracker", "viagra", "warez", "xxx")
PLAIN_WORDS = (
    "article", "blog", "book", "cheap", "city", "daily", "data", "farm", "food", "free", "forum", "garden", "health", "home",
    "house", "learn", "mail", "media", "music", "news", "online", "open", "page", "post", "report", "school", "science", "shop",
    "sport", "store", "story", "tech", "the", "times", "travel", "web", "weekly", "win", "world")
BUCKETS = 1 << 18
CLASS_BUCKETS = 1 << 16
LONGEST_WORD = 24
#: Letters that a counted word has at least: shorter path parts are codes, with which any name could be split.
SHORTEST_WORD = 3
#: A word not counted is no likelier than one of so many, however small the corpus.
LEAST_TOTAL = 1_000_000
_PIECES = re.compile(r"[a-z]+|[0-9]+")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _slots(word: str, buckets: int) -> tuple[int, int]:
    raw = word.encode()
    return zlib.crc32(raw) % buckets, zlib.crc32(raw[::-1]) % buckets


@dataclass
class Unigrams:
    """Word counts of the corpus in two tables of fixed size; the smaller of a word's two counts is its count."""

    first: np.ndarray
    second: np.ndarray
    total: float

    def cost(self, word: str) -> float:
        if word.isdigit():
            return 3.0
        a, b = _slots(word, len(self.first))
        count = min(self.first[a], self.second[b])
        total = max(self.total, LEAST_TOTAL)
        if count > 0 and len(word) >= SHORTEST_WORD:
            return -math.log(count / total)
        return math.log(total) + 2.5 * len(word)  # unknown: dearer with each letter

    def segment(self, name: str) -> list[str]:
        """The cheapest split of a run of letters into words (Viterbi)."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, start = min((best[s] + self.cost(name[s:end]), s) for s in range(max(0, end - LONGEST_WORD), end))
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end]:end])
            end = back[end]
        return words[::-1]

    def words(self, host: str, path: str, known: dict[str, list[str]]) -> list[str]:
        """Words of a URL: names of the host split, words of the path as they stand, numbers as one mark."""
        out = []
        for piece in _PIECES.findall(host):
            if piece not in known:
                if len(known) > 50_000:
                    known.clear()
                known[piece] = ["#"] if piece.isdigit() else self.segment(piece)
            out += known[piece]
        return out + ["#" if p.isdigit() else f"/{p}" for p in _PIECES.findall(path.lower())]


def count_words(urls: DataFrame, seeds: Sequence[str], seed_count: int) -> Unigrams:
    """Counts of the words of all paths and of hyphenated names in hosts, in ``BUCKETS`` slots; ``seeds`` are added.

    Other names of hosts may be words run together, so they do not count as words. Words of fewer letters than
    ``SHORTEST_WORD`` count for the total only.
    """
    hyphened = F.array_join(F.regexp_extract_all("host", F.lit("([a-z]+(?:-[a-z]+)+)"), F.lit(1)), "/")
    pieces = F.regexp_extract_all(F.lower(F.concat_ws("/", hyphened, "path")), F.lit("([a-z]+)"), F.lit(1))
    words = urls.select(F.explode(pieces).alias("w")).where(F.length("w") <= LONGEST_WORD)
    tables = []
    for text in (F.col("w"), F.reverse("w")):
        slot = F.pmod(F.crc32(text.cast("binary")), F.lit(BUCKETS)).cast("int")
        counts = words.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most BUCKETS rows
        values = np.zeros(BUCKETS)
        values[counts["slot"].to_numpy()] = counts["n"].to_numpy()
        tables.append(values)
    total = tables[0].sum() + seed_count * len(seeds)
    for word in seeds:
        for values, slot in zip(tables, _slots(word, BUCKETS), strict=True):
            values[slot] += seed_count
    return Unigrams(tables[0], tables[1], float(max(total, 1)))


@dataclass
class NaiveBayes:
    """Log odds of each word's bucket for the class to block."""

    odds: np.ndarray

    def score(self, words: Sequence[str]) -> float:
        """Chance of the class to block, with even odds before any word is read."""
        total = float(sum(self.odds[zlib.crc32(w.encode()) % len(self.odds)] for w in words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def learn(urls: DataFrame, unigrams: Unigrams, blocked: frozenset[str], plain: Sequence[str], smoothing: float = 200.0) -> NaiveBayes:
    """Multinomial naive Bayes over all URLs: those with a word of ``blocked`` are the class to block.

    Word counts per class go into ``CLASS_BUCKETS`` buckets, so the model has a fixed size whatever the corpus has.
    The seed words count as one URL each, so that a corpus without examples still has a model.
    """
    def examples(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for part in parts:
            counts: dict[tuple[int, bool], int] = {}
            for host, path in zip(part["host"].to_pylist(), part["path"].to_pylist(), strict=True):
                words = unigrams.words(host, path, known)
                bad = any(w.lstrip("/") in blocked for w in words)
                for w in words:
                    key = zlib.crc32(w.encode()) % CLASS_BUCKETS, bad
                    counts[key] = counts.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())],
                names=["bucket", "bad", "n"])

    found = map_batches(urls.select("host", "path"), examples, "bucket int, bad boolean, n bigint")
    found = found.groupBy("bucket", "bad").agg(F.sum("n").alias("n")).toArrow()  # at most two rows a bucket
    counts = np.zeros((2, CLASS_BUCKETS))
    counts[found["bad"].to_numpy(zero_copy_only=False).astype(int), found["bucket"].to_numpy()] = found["n"].to_numpy()
    for kind, words in ((1, blocked), (0, plain)):
        for w in words:
            for form in (w, f"/{w}"):
                counts[kind, zlib.crc32(form.encode()) % CLASS_BUCKETS] += 1
    # each class leans on the rates of all URLs, so that common words say nothing where examples are few
    common = (counts.sum(0) + 1e-9) / (counts.sum() + 1e-9 * CLASS_BUCKETS)
    rates = (counts + smoothing * common) / (counts.sum(1, keepdims=True) + smoothing)
    odds = np.log(rates[1]) - np.log(rates[0])
    odds[counts.sum(0) == 0] = 0.0
    return NaiveBayes(odds)


def judge_urls(
    pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED_WORDS,
    plain: Sequence[str] = PLAIN_WORDS, threshold: float = 0.5,
) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``words``, ``score``, ``rule`` and ``verdict``.

    The longest rule that fits decides; without one the method blocks from ``threshold`` on. A null or odd url has empty
    host and path, no words and the verdict allow. Columns named like the results are replaced. Three passes over the
    urls; both models have a fixed size.
    """
    new = ("host", "path", "words", "score", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in new or c == url]
    rows = pages.select(*[quoted(c) for c in kept]).withColumns({"__tm_host": host_of(quoted(url)), "__tm_path": path_of(quoted(url))})
    urls = rows.select(F.col("__tm_host").alias("host"), F.col("__tm_path").alias("path"))
    unigrams = count_words(urls, [*blocked, *plain], 20)
    model = learn(urls, unigrams, frozenset(blocked), plain)
    shared = share(pages.sparkSession, (unigrams, model))  # two tables of BUCKETS and one of CLASS_BUCKETS numbers
    names = [*rows.columns, "__tm_words", "__tm_score"]

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, bayes = shared_value(shared)
        known: dict[str, list[str]] = {}
        for part in parts:
            words = [split.words(h, p, known) for h, p in zip(part["__tm_host"].to_pylist(), part["__tm_path"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(words, pa.list_(pa.string())), pa.array([bayes.score(w) for w in words], pa.float64())], names=names)

    scored = map_batches(rows, judge, plus(rows.schema, __tm_words=ArrayType(StringType()), __tm_score=DoubleType()))
    rule, verdict = rule_of(F.col("__tm_host"), F.col("__tm_path"), rules)
    own = F.when((F.col("__tm_score") > threshold) & (F.size("__tm_words") > 0), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        *[quoted(c) for c in kept if c.lower() not in new], F.col("__tm_host").alias("host"), F.col("__tm_path").alias("path"),
        F.col("__tm_words").alias("words"), F.col("__tm_score").alias("score"), rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
