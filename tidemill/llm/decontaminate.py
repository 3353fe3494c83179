"""Benchmark decontamination: training words stream through a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.automaton import Matcher
from tidemill.llm.helpers import WORD_BYTES, map_batches, marked_words, new_name, quoted, share, shared_value, with_text
from tidemill.session import materialize

WINDOW = 10
#: Item text of one automaton: 2 MB take some 400 MB while it is built on the driver, and 40 MB as sent to the tasks.
BLOCK_BYTES = 2_000_000
SPANS = "array<struct<first:bigint,last:bigint>>"


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about ``block_bytes`` of text, by a hash of the id; each block is one automaton."""
    items = benchmark.select(
        F.coalesce(quoted(item_id).cast("string"), F.lit("")).alias("item"), quoted(text).cast("binary").alias("text")
    ).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    for b in range(blocks):
        rows = (items if blocks == 1 else items.where(block == b)).collect()  # about block_bytes
        yield sorted((r.item, marked_words(bytes(r.text))) for r in rows)


def find_items(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Where benchmark items occur: ``(id, n_words, spans, item_ids)``, one row per row of ``documents``.

    A document word inside an occurrence of ``window`` consecutive item words (or of a whole shorter item) is hit;
    ``spans`` are the merged runs of hit words, from 0. Documents are read once, without a shuffle, for each
    ``block_bytes`` of benchmark text. Null and empty texts have no words; items without words hit nothing; rows that
    repeat are answered each; an empty benchmark hits nothing; a null item id counts as ''.
    """
    rows = documents.select(
        quoted(id_column).alias("id"), quoted(text).cast("binary").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("item_ids"),
    )
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    for number, items in enumerate(blocks):
        if number:  # one automaton in memory at a time
            rows = materialize(rows)
        shared = share(documents.sparkSession, Matcher(items, window))  # bounded by block_bytes

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = shared_value(shared)
            for batch in batches:
                counts, spans, ids = [], [], []
                for raw, old, seen in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), batch["item_ids"].to_pylist(), strict=True):
                    words = marked_words(raw)
                    counts.append(len(words))
                    hit, items, _ = matcher.find(words)
                    spans.append([{"first": a, "last": b} for a, b in union_of([(x["first"], x["last"]) for x in old or []], hit)])
                    ids.append(sorted({*(seen or []), *items}))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["text"], pa.array(counts, pa.int64()),
                     pa.array(spans, batch.schema.field("spans").type), pa.array(ids, batch.schema.field("item_ids").type)],
                    schema=batch.schema)

        rows = map_batches(rows, search, rows.schema)
    return rows.select(F.col("id").alias(id_column), "n_words", "spans", "item_ids")


def union_of(one, other) -> list[tuple[int, int]]:
    """Runs of words in either list, merged where they meet."""
    merged: list[list[int]] = []
    for first, last in sorted([*map(tuple, one), *map(tuple, other)]):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    return [(a, b) for a, b in merged]


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def cut_out(raw: bytes, spans) -> bytes:
    """The text without the words of the spans; a line break stands for each."""
    bounds = [m.span() for m in _WORD.finditer(raw.translate(WORD_BYTES))]
    pieces, at = [], 0
    for first, last in spans:
        pieces.append(raw[at:bounds[first][0]].rstrip(b" \t"))
        at = bounds[last][1]
    pieces.append(raw[at:].lstrip(b" \t"))
    return b"\n".join(p for p in pieces if p)


def remove_items(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str | None = "n_chars", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.8, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``documents`` without the spans of benchmark items, and without documents that are mostly such spans.

    A document in which more than ``max_coverage`` of the words are hit is dropped. From others the hit spans are cut,
    again and again until no window is left in what then stands together. Untouched texts stay byte for byte. Column
    ``n_chars``, where there is one, follows the text. Nulls, empty texts and extra columns pass unchanged. With more
    than one block of items the blocks take turns until a whole round cuts nothing.
    """
    at = documents.columns.index(text)
    sizes = documents.columns.index(n_chars) if n_chars in documents.columns else None
    mark = new_name(documents, "hit_words")
    rows = documents.withColumn(mark, F.array().cast("array<bigint>"))  # words at first, and words hit

    def cleaner(shared):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = shared_value(shared)
            for batch in batches:
                texts, marks = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                changed = set()
                for i, value in enumerate(texts):
                    raw = value.encode() if value else b""
                    words = marked_words(raw)
                    total, hit = marks[i] or (len(words), 0)
                    spans, _, _ = matcher.find(words)
                    while spans:
                        changed.add(i)
                        hit += sum(b - a + 1 for a, b in spans)
                        raw = cut_out(raw, spans)
                        spans, _, _ = matcher.find(marked_words(raw))
                        texts[i] = raw.decode()
                    marks[i] = (total, hit)
                batch = with_text(batch, at, texts, sizes, changed) if changed else batch
                columns = [*batch.columns[:-1], pa.array(marks, batch.schema.field(mark).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        return clean

    hits = -1
    while True:
        for number, items in enumerate(item_blocks(benchmark, item_id, item_text, block_bytes)):
            one = share(documents.sparkSession, Matcher(items, window))  # one block's automaton at a time
            rows = map_batches(materialize(rows) if number else rows, cleaner(one), rows.schema)
        if not number:
            break
        rows = materialize(rows)
        now = rows.agg(F.sum(quoted(mark)[1])).first()[0] or 0
        if now == hits:
            break
        hits = now
    kept = rows.where(quoted(mark)[1] <= F.lit(max_coverage) * quoted(mark)[0])
    return kept.drop(mark)
