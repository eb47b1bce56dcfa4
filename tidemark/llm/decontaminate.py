"""Benchmark decontamination with a generalised suffix automaton.

Items are lower-cased (A-Z) and cut into words; a window is 10 consecutive words of an item, or
the whole of a shorter item. Items are dealt into blocks of bounded size, each block's automaton
is broadcast, and every document is streamed through every block's automaton, which yields the
longest match that ends at each word. A match of 10 words or more, or one that ends with a whole
short item, marks its words as hit. Runs of words whose neighbouring pairs no item has are not
streamed: no window can lie there.

Null or wordless texts have no words, and such items no windows. Repeated rows each give a row; items
with the same id count once. An item without an id is called "null". Without items, or without documents, nothing is
hit. Items that tie in a match are all counted. Texts of any length are streamed whole; columns may have clashing names. With several blocks the driver and the tasks
hold one at a time.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, map_slices, materialise, new_path, slices

WINDOW = 10
#: Bytes of item text in a block: the bound of what is broadcast.
BLOCK_BYTES = 2_000_000
#: A document with at least this share of hit words is removed, any other loses its hit spans.
COVERAGE = 0.5

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        for sequence in sequences:
            last = 0
            for c in sequence:
                last = self._add(last, c)

    def _add(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, c, known)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def matches(self, sequence: list[int]) -> list[int]:
        """Length of the longest match that ends at each place."""
        out, state, n = [], 0, 0
        move, link, length = self.next, self.link, self.length
        for c in sequence:
            while state and c not in move[state]:
                state = link[state]
                n = length[state]
            if c in move[state]:
                state, n = move[state][c], n + 1
            out.append(n)
        return out


class Block:
    """What a task needs of a block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.ids, self.windows = window, {}, {}
        sequences = []
        for name, text in items:
            sequence = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            if sequence:
                sequences.append(sequence)
                n = min(window, len(sequence))
                for i in range(len(sequence) - n + 1):
                    self.windows.setdefault(tuple(sequence[i : i + n]), set()).add(name)
        self.short = sorted({len(w) for w in self.windows if len(w) < window})
        self.least = min(map(len, self.windows), default=1)
        self.automaton = Automaton(sequences)
        v = len(self.ids)
        self.pairs = np.unique(np.array([a * v + b for s in sequences for a, b in zip(s, s[1:])], np.int64))

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of words in which every pair is one of an item."""
        n, v = len(ids), len(self.ids)
        if self.least == 1 or not len(self.pairs):
            good = ids >= 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
            return list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        codes = ids[at] * v + ids[at + 1]
        found = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        at = at[self.pairs[found] == codes]
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 2
        keep = last - first >= self.least
        return list(zip(first[keep].tolist(), last[keep].tolist()))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Mask of hit words (None: none) and the items that have windows here."""
        if len(words) < self.least:
            return None, set()
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        mask, items = None, set()
        for first, last in self.runs(ids):
            run = ids[first:last].tolist()
            for i, n in enumerate(self.automaton.matches(run)):
                for size in (*self.short, self.window):
                    if size > n:
                        break
                    if named := self.windows.get(tuple(run[i + 1 - size : i + 1])):
                        if mask is None:
                            mask = np.zeros(len(words), bool)
                        mask[first + i + 1 - size : first + i + 1] = True
                        items |= named
        return mask, items


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks, one at a time, at least one. No block has more bytes than ``block_bytes``, but for a single item that is longer."""
    rows = as_bytes(items, text_col, id_col).select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.col(text_col).alias("text")).where(F.length("text") > 0).distinct()
    rows = materialise(rows.withColumn("size", F.length("text")))
    total, longest = (x or 0 for x in rows.agg(F.sum("size"), F.max("size")).first())
    count = max(1, -(-total // block_bytes))
    while True:
        numbered = rows.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(count)))
        largest = numbered.groupBy("block").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0
        if largest <= max(block_bytes, longest):
            break
        count *= 2
    for k in range(count):
        yield [(r.name, bytes(r.text)) for r in numbered.where(F.col("block") == k).select(F.col("name"), "text").collect()]


def _scan_block(rows: DataFrame, items: list, window: int, id_col: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def make():
        block = Block(shared.value, window)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, places, names = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                mask, found = block.hits(words)
                n_words.append(len(words))
                places.append([] if mask is None else np.flatnonzero(mask).tolist())
                names.append(sorted(found))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=[id_col, "n_words", "hit_words", "items"])

        return apply

    kind = rows.schema[id_col].dataType.simpleString()
    return map_slices(rows, make, f"{id_col} {kind}, n_words long, hit_words array<long>, items array<string>")


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Row per document: id, n_words, hit_words (places of the hit words), items (sorted).

    With several blocks, what each finds is written before the next is read.
    """
    blocks = item_blocks(items, block_bytes=block_bytes)
    rows = as_bytes(docs, text_col, id_col)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan_block(rows, first, window, id_col)
    keyed = materialise(rows.withColumn("_at", F.monotonically_increasing_id()))
    found = new_path(keyed.sparkSession)
    for number, block in enumerate(itertools.chain((first, second), blocks)):
        part = _scan_block(keyed.select("_at", text_col), block, window, "_at")
        part.where(F.size("hit_words") > 0 if number else F.lit(True)).write.mode("append").parquet(found)  # the first has all rows
    merged = keyed.sparkSession.read.parquet(found).groupBy("_at").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return keyed.select("_at", id_col).join(merged, "_at").drop("_at")


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs, items, id_col, text_col, window)
    return found.select(
        id_col,
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def clean_text(text: str, places: list[int], coverage: float) -> str | None:
    """The text without its hit spans; None if they cover too much of it."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.translate(_WORD_BYTES))]
    hit = np.zeros(len(spans), bool)
    hit[places] = True
    if hit.sum() >= coverage * len(hit):
        return None
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()
    out, done = [], 0
    for first, last in zip(edge[::2], edge[1::2]):
        out.append(raw[done : spans[first][0]])
        done = spans[last - 1][1]
    return (b"".join(out) + raw[done:]).decode()


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows and columns of ``docs``: hit spans are cut out of the texts, and rows whose hit words
    reach the coverage limit go; n_chars, if there, follows."""
    columns = docs.columns
    at = columns.index(text_col)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(columns))])
    count_at = columns.index("n_chars") if "n_chars" in columns else None
    blocks = item_blocks(items, block_bytes=block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shared, found = docs.sparkSession.sparkContext.broadcast(first), plain
    else:
        shared, keyed = None, materialise(plain.withColumn("_row", F.monotonically_increasing_id()))
        hits = scan(keyed, items, "_row", f"_c{at}", window, block_bytes).where(F.size("hit_words") > 0)
        found = keyed.join(hits.select("_row", "hit_words"), "_row", "left").drop("_row")

    def run(batches):
        block = Block(shared.value, window) if shared else None
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            hit_words = [None] * len(texts) if shared else batch.column(len(columns)).to_pylist()
            stay, changed = np.ones(len(texts), bool), []
            for i, text in enumerate(texts):
                if shared:
                    mask, _ = block.hits(words_of((text or "").encode()))
                    places = None if mask is None else np.flatnonzero(mask)
                else:
                    places = hit_words[i]
                if places is not None and len(places):
                    texts[i] = clean_text(text, places, coverage)
                    stay[i] = texts[i] is not None
                    changed.append(i)
            out = list(batch.columns[: len(columns)])
            if changed:
                out[at] = pa.array(texts, batch.schema.field(at).type)
                if count_at is not None:
                    counts = batch.column(count_at).to_pylist()
                    for i in changed:
                        counts[i] = None if texts[i] is None else len(texts[i])
                    out[count_at] = pa.array(counts, batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names[: len(columns)]).filter(pa.array(stay))

    return found.mapInArrow(run, plain.schema).toDF(*columns)
