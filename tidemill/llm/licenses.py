"""Licence scans: matching statistics against licence texts, chained into covered template spans."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.automaton import Matcher
from tidemill.llm.helpers import map_batches, marked_words, quoted

# Phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Passages of public licence texts, several for a label where a licence has more than one usual notice.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
            " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
            " permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
                 " compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
            " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
            " conditions and the following disclaimer"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
            " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
            " later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
            " granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of"
            " his or her rights to the work worldwide under copyright law"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
             " liable for any damages arising from the use of this software"),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
              " accompanying documentation covered by this license"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
)


class TemplateScanner:
    """Streams words past the automaton of all templates and chains long matches per template.

    A template without words is never found, nor is one of a single word.
    """

    def __init__(self, templates: Sequence[tuple[str, str]], min_match: int, max_gap: int):
        self.words = [marked_words(t.encode()) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.min_match, self.max_gap = min_match, max_gap
        self.shortest = max(2, min([min_match, *map(len, self.words)]))
        self.matcher = Matcher(list(enumerate(self.words)), 1 << 30)
        auto = self.matcher.automaton
        self.places: list[set[tuple[int, int]]] = [set() for _ in auto.size]  # (template, last word) of each state
        for t, words in enumerate(self.words):
            at = 0
            for i, word in enumerate(words):
                at = auto.step[at][word]
                self.places[at].add((t, i))
        for s in sorted(range(1, len(auto.size)), key=auto.size.__getitem__, reverse=True):
            if auto.size[auto.link[s]] >= min(min_match, 2):
                self.places[auto.link[s]] |= self.places[s]

    def matches(self, words: Sequence[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """Matches that cannot go on as ``(first, last, template, last template word)``, by their last word.

        The state and its suffixes name every place of a template that ends like the text so far. Such a place is a match
        when its template's next word is not the text's, and when it has ``min_match`` words or is a whole shorter template.
        """
        auto = self.matcher.automaton
        step, link, size, root = auto.step, auto.link, auto.size, auto.step[0]
        at = length = 0
        for i, word in enumerate(words):
            if not at and word not in root:
                continue
            while at and word not in step[at]:
                at = link[at]
                length = size[at]
            if word in step[at]:
                at = step[at][word]
                length += 1
            else:
                length = 0
            if length >= self.shortest:
                yield from self._ended(i, at, length, words[i + 1] if i + 1 < len(words) else None)

    def _ended(self, last: int, state: int, length: int, following: bytes | None) -> Iterator[tuple[int, int, int, int]]:
        auto, seen = self.matcher.automaton, set()
        while length >= self.shortest:
            for t, end in sorted(self.places[state] - seen):
                template = self.words[t]
                over = end + 1 == len(template) or template[end + 1] != following
                if over and (length >= self.min_match or length == len(template)):
                    yield last - length + 1, last, t, end
            seen |= self.places[state]
            state = auto.link[state]
            length = auto.size[state]

    def scan(self, words: Sequence[bytes], min_coverage: float) -> list[tuple[str, int, int, float]]:
        """Spans ``(label, first, last, covered share of the template)`` of chains that cover enough of a template.

        A chain takes matches of one template as long as both the text and the template go forward and at most
        ``max_gap`` words of the text lie between; each match ends the chain that covers most. A passage belongs to one
        template: of chains that overlap the one with the largest share stays, then the one with more covered words.
        """
        chains: dict[int, list[tuple[int, int, int, int]]] = {}  # template: first, last, last template word, covered words
        found: list[tuple[float, int, int, int, str]] = []
        for first, last, t, end in self.matches(words):
            n = last - first + 1
            best = (first, last, end, n)
            near = [c for c in chains.get(t, ()) if first - c[1] <= self.max_gap]
            for start, stop, before, covered in near:
                fresh = min(n, end - before, last - stop)
                if fresh > 0 and covered + fresh > best[3]:
                    best = (start, last, end, covered + fresh)
            chains[t] = [*near, best]
            share = best[3] / len(self.words[t])
            if share >= min_coverage:
                found.append((-round(share, 6), -best[3], best[0], last, self.labels[t]))
        starts: list[int] = []
        spans: list[tuple[str, int, int, float]] = []  # apart from each other, in text order
        for share, _, first, last, label in sorted(found):
            at = bisect_left(starts, first)
            if (at == 0 or spans[at - 1][2] < first) and (at == len(spans) or spans[at][1] > last):
                starts.insert(at, first)
                spans.insert(at, (label, first, last, -share))
        return spans


SCHEMA = ("id {id}, n_words bigint, places array<struct<first:bigint,last:bigint,label:string>>,"
          " spans array<struct<label:string,first:bigint,last:bigint,coverage:double>>, score double")


def scan_licenses(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES, min_match: int = 4, max_gap: int = 12, min_coverage: float = 0.6,
) -> DataFrame:
    """Licence passages of each text: ``(id, n_words, places, spans, score)``, one row per row of ``documents``.

    ``places`` are all occurrences of the phrases, ``spans`` the chains of long matches that cover at least
    ``min_coverage`` of a template. ``score`` is 1 with a phrase, else the largest covered share, else 0. Null and empty
    texts have no words. One pass without a shuffle; the automata grow with the licence texts, never with the data.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = TemplateScanner(templates, min_match, max_gap)
        wanted = [((label, n), marked_words(p.encode())) for n, (p, label) in enumerate(phrases.items())]
        finder = Matcher(wanted, 1 + max([0, *(len(w) for _, w in wanted)]))
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for raw in batch["text"].to_pylist():
                words = marked_words(raw)
                places = [{"first": a, "last": b, "label": item[0]} for a, b, item in sorted(finder.find(words)[2])]
                spans = scanner.scan(words, min_coverage)
                score = 1.0 if places else max([0.0, *(s[3] for s in spans)])
                for column, value in zip(rows, (len(words), places, [dict(zip(("label", "first", "last", "coverage"), s, strict=True)) for s in spans], score), strict=True):
                    column.append(value)
            place = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())])
            span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])
            kinds = (pa.int64(), pa.list_(place), pa.list_(span), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))],
                names=["id", "n_words", "places", "spans", "score"])

    rows = documents.select(quoted(id_column).alias("id"), quoted(text).cast("binary").alias("text"))
    found = map_batches(rows, scan, SCHEMA.format(id=rows.schema["id"].dataType.simpleString()))
    return found.withColumnRenamed("id", id_column)
