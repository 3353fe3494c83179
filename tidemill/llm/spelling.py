"""Spelling variants: words one edit apart, found with a bit-sliced position index, and the forms they go back to.

Of two words one edit apart the longer one (either, if equal) has L letters, and the edit leaves their first
(L - 1) // 2 letters alone or their last L - 1 - (L - 1) // 2. So a word of n letters is put, for L = n and L = n + 1, into
the group of its beginning and that of its end; near words meet in one. The words of a group are the bits of whole
numbers: for each place and letter one number marks the words with this letter there. A word is matched against all
others at once, letter by letter, by a recurrence on such numbers: the words that agree so far, those with one other
letter, and, by the numbers of the next and the last place, those with one letter more or less.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.helpers import map_batches, quoted
from tidemill.session import materialize

LEAST_LETTERS = 5
LEAST_COUNT = 3
#: Words of a group that are matched at once; larger groups are cut into blocks that meet two by two.
BLOCK_WORDS = 4096
#: Words a task counts before it hands them on.
HELD_WORDS = 500_000
_ONE_IN = 97


def count_words(documents: DataFrame, id_column: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``(word, n)`` over all texts, A-Z lower-cased, of words with at least ``least_letters`` letters.

    In one of 97 (document, run) pairs by hash a letter is deleted, so that the table holds slips of the pen. A null
    id counts as empty text. Tasks add up before the shuffle.
    """
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = re.compile("[A-Za-zÀ-ÿ]+")
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for part in parts:
            for own, raw in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                if not raw:
                    continue
                found = Counter(run.findall(raw.lower().decode()))  # of bytes: A-Z only
                start = zlib.crc32(f"{own or ''}:".encode())
                runs = list(found)
                for word, h in zip(runs, map(zlib.crc32, map(str.encode, runs), repeat(start)), strict=False):
                    if h % _ONE_IN == 0:
                        at, n = h % len(word), found.pop(word)
                        held[word[:at] + word[at + 1:]] += n
                held.update(found)
                if len(held) > HELD_WORDS:
                    yield rows()
        yield rows()

    texts = documents.select(quoted(id_column).cast("string").alias("id"), quoted(text).cast("binary").alias("text"))
    found = map_batches(texts, count, "word string, n bigint").where(F.char_length("word") >= least_letters)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def near_in_group(words: list[str], indexed: list[str], length: int, head: int, tail: bool) -> Iterator[tuple[int, int]]:
    """Per word the indexed words one edit away as bits, with the word's place: ``(place, bits)``.

    Pairs are of two words of ``length`` letters, or of one such and one with a letter less. The pairs belong to the
    group of beginnings if their first ``head`` letters agree, else to that of ends (``tail``).
    """
    index: dict[tuple[int, str], int] = {}
    whole = short = 0
    for i, word in enumerate(indexed):
        bit = 1 << i
        if len(word) == length:
            whole |= bit
        elif len(word) == length - 1:
            short |= bit
        for place in enumerate(word):
            index[place] = index.get(place, 0) | bit
    every = whole | short
    for at, word in enumerate(words):
        same, other, more, less, begin = every, 0, 0, 0, every
        for place, letter in enumerate(word):
            here = index.get((place, letter), 0)
            # one letter more in the indexed word: its letters are one place on; one less: one place back
            more = (more | same) & index.get((place + 1, letter), 0)
            less = less & index.get((place - 1, letter), 0) | same
            other = other & here | same & ~here
            same &= here
            if place == head - 1:
                begin = same
        if len(word) == length:
            found = other & whole | less & short
        elif len(word) == length - 1:
            found = (more | same) & whole
        else:
            continue
        found &= ~begin if tail else begin
        if found:
            yield at, found


def near_words(vocabulary: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``(word, n_near, near, near_n)`` of the words of ``vocabulary`` (``word``, ``n``) that have a word one edit away.

    ``near`` is the one of largest n, ties to the smallest in code-point order. A group of more than ``block`` words is
    cut into blocks by hash, and each pair of blocks is a group of its own, so a beginning that very many words share
    lands in no single task. Pairs of words are never written: a task gives each of its words a count and its best.
    """
    size = F.char_length("word")
    both = vocabulary.select("word", "n", F.explode(F.array(size, size + 1)).alias("length"))
    half = F.expr("(length - 1) div 2").cast("int")
    sides = F.explode(F.array(
        F.struct(F.lit(False).alias("tail"), F.substring(F.col("word"), F.lit(1), half).alias("part")),
        F.struct(F.lit(True).alias("tail"), F.substring(F.col("word"), size - (F.col("length") - 1 - half) + 1, F.col("length") - 1 - half).alias("part"))))
    placed = both.select("word", "n", "length", sides.alias("side")).select("word", "n", "length", "side.tail", F.xxhash64("length", "side.tail", "side.part").alias("key"))
    sizes = placed.groupBy("key").count().where("count > 1")
    # a word alone in its group has nobody to meet
    met = placed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("own")
    met = met.select("key", "word", "n", "length", "tail", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    roles = F.explode(F.array(
        F.struct(F.col("own").alias("a"), F.col("with").alias("b"), F.lit(True).alias("asks")),
        F.struct(F.col("with").alias("a"), F.col("own").alias("b"), F.lit(False).alias("asks"))))
    dealt = met.select("key", "word", "n", "length", "tail", roles.alias("r")).select("key", "word", "n", "length", "tail", "r.a", "r.b", "r.asks")
    order = ["key", "a", "b", "length", "tail", "asks", F.col("n").desc(), "word"]
    dealt = dealt.repartition("key", "a", "b").sortWithinPartitions(*order)

    def match(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "n_near", "near", "near_n"]
        key, asking, indexed = None, [], []

        def found() -> pa.RecordBatch:
            rows, (_, length, tail) = [], key
            for at, bits in near_in_group(asking, [w for w, _ in indexed], length, (length - 1) // 2, tail):
                best = indexed[(bits & -bits).bit_length() - 1]  # sorted by count and word
                rows.append((asking[at], bits.bit_count(), *best))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for part in parts:
            for *place, length, tail, asks, word, n in zip(*(part[c].to_pylist() for c in ("key", "a", "b", "length", "tail", "asks", "word", "n")), strict=True):
                if key is None or (tuple(place), length, tail) != key:
                    if asking and indexed:
                        yield found()
                    key, asking, indexed = (tuple(place), length, tail), [], []
                if asks:
                    asking.append(word)
                else:
                    indexed.append((word, n))
        if asking and indexed:
            yield found()

    partial = map_batches(dealt, match, "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", "best.near", (-F.col("best.less")).alias("near_n"))


def spelling_groups(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
    block: int = BLOCK_WORDS,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per distinct word with enough letters and occurrences.

    ``form`` is the near word of largest n (ties: first in code-point order) if that n is at least twice the word's
    own, else null; ``root`` is the end of the chain of forms, the word itself if it has none. Counts at least double
    along a chain, so it ends. Null and empty texts have no words; repeated rows count again; an empty table gives no
    rows.
    """
    words = materialize(count_words(documents, id_column, text, least_letters).where(F.col("n") >= least_count))
    near = words.join(near_words(words, block), "word", "left")
    takes = F.col("near_n") >= 2 * F.col("n")
    formed = materialize(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")))
    # each round doubles the way a word looks ahead; words without a form are ends
    ahead = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(ahead.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ahead = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return formed.join(ahead, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
