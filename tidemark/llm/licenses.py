"""License scans by an exact set-similarity join of text blocks with notice templates.

Blocks are all windows of words of a document, for each template as long as the template and a
quarter (at least two words) more, so that line breaks, paragraphs and a few foreign words do no harm, while
words scattered over a page are no notice. A block meets a template if it has at least the
containment share of the template's distinct words. Words are ordered by their frequency over all
documents, rarest first. A template of n words that needs r of them is met only by blocks with one of its first
n - r + 1 words (prefix filter); only windows around such words are looked at. There must be r template
words at all (length filter), and where the rarest of them is the template's k-th word, no more than n - k + 1 can be
shared (positional filter). What passes is counted exactly, window by window.

Sets have no order: a block with a template's words in any order meets it, so a short template can be met by words that say something else.

Null and empty texts have no words, no labels and score 0. Ties between templates do not matter, as labels are a set.
Repeated rows each give a row, an empty table none; texts of any length are scanned whole; columns may have
clashing names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, map_slices

# Phrases of the base scan, and public notices.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see http://www.gnu.org/licenses/."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]
CONTAINMENT = 0.9
#: Words of a block for each word of the template.
STRETCH = 1.25

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def phrase_starts(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    out, i, n = [], -1, len(phrase)
    try:
        while True:
            i = words.index(phrase[-1], i + 1)
            if i >= n - 1 and words[i - n + 1 : i + 1] == phrase:
                out.append(i - n + 1)
    except ValueError:
        return out


def template_words(templates: list[tuple[str, str]]) -> list[tuple[str, list[bytes]]]:
    return [(label, words_of(t.encode())) for label, t in templates]


def block_words(count: int) -> int:
    """Length of the blocks that are held against a template of so many words."""
    return max(count + 2, math.ceil(STRETCH * count))


def frequencies(rows: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences of the templates' words over all documents; as many rows as the vocabulary has."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[bytes, int] = {}
        for text in batch.column(1).to_pylist():
            for w in filter(vocabulary.__contains__, words_of(text)):
                sums[w] = sums.get(w, 0) + 1
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])

    found = map_slices(rows, lambda: count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in found.collect()}


class Matcher:
    def __init__(self, templates: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], containment: float):
        self.templates, self.index = [], {}  # prefix word -> templates
        for k, (label, words) in enumerate(templates):
            ordered = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
            need = math.ceil(containment * len(ordered) - 1e-9)
            self.templates.append((label, {w: at for at, w in enumerate(ordered)}, need, block_words(len(words))))
            for w in ordered[: len(ordered) - need + 1]:
                self.index.setdefault(w, []).append(k)
        self.any = frozenset(self.index)

    def document(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(label, largest containment) of each template that a block of the document meets."""
        if self.any.isdisjoint(words):
            return []
        out, here = [], set(words)
        for k in {k for w in self.any & here for k in self.index[w]}:
            label, place, need, length = self.templates[k]
            if len(place.keys() & here) < need:  # length
                continue
            best = self._best(words, place, need, length)
            if best:
                out.append((label, best / len(place)))
        return out

    @staticmethod
    def _best(words: list[bytes], place: dict[bytes, int], need: int, length: int) -> int:
        """Most template words in a block, 0 if fewer than needed."""
        found = [(i, place[w]) for i, w in enumerate(words) if w in place]
        first, best, a = len(place) - need, 0, 0
        while a < len(found):
            # template words with no wide gap between them: no block reaches beyond
            b = a + 1
            while b < len(found) and found[b][0] - found[b - 1][0] < length:
                b += 1
            run = found[a:b]
            # length filter again, and the positional one: words rarer than the rarest here are absent
            if len({at for _, at in run}) >= need and min(at for _, at in run) <= first:
                counts, low, distinct = [0] * len(place), 0, 0
                for i, at in run:
                    distinct += not counts[at]
                    counts[at] += 1
                    while run[low][0] <= i - length:
                        counts[run[low][1]] -= 1
                        distinct -= not counts[run[low][1]]
                        low += 1
                    best = max(best, distinct)
            a = b
        return best if best >= need else 0


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest containment)."""
    rows = as_bytes(docs, text_col, id_col)
    sets = template_words(templates or TEMPLATES)
    frequency = frequencies(rows, frozenset(w for _, t in sets for w in t))
    phrases = {label: p.encode().split() for label, p in PHRASES.items()}

    def make():
        matcher = Matcher(sets, frequency, containment)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                places = {label: phrase_starts(words, p) for label, p in phrases.items()} if b"license" in words else {}
                base = {label for label, at in places.items() if at}
                starts = [i for at in places.values() for i in at]
                found = matcher.document(words)
                row = len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {label for label, _ in found})), max((s for _, s in found), default=0.0)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

        return apply

    kind = rows.schema[id_col].dataType.simpleString()
    return map_slices(rows, make, f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
