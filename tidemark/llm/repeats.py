"""Removal of long repeated byte strings with run-length indexes.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere, in the same
document or another. Windows of that length are dealt out by their minimizer (the least hash of
their 24-byte grams): equal windows have equal minimizers, and a run of neighbouring windows with
one minimizer travels as one span. Only spans whose minimizer occurs more than once go on; equal spans
one after the other, as in a run of one character, travel as one with their number. Spans
that are equal as a whole (by minimizer and a hash of all their bytes, 128 bits together) are repeated as a whole; where a minimizer has several different spans,
one of each kind goes into an index, which compares bytes.

An index holds the spans of some minimizers: suffix array, run-compressed Burrows-Wheeler
transform, and samples at the two ends of each run. The longest match with the neighbour in suffix
order is found by comparison at the samples only; from there it is streamed along the text, since
inside a run it shrinks by one with each byte. A window is repeated if a match of its length
starts with it. A minimizer with more different spans than fit into one index is split: its windows are dealt out anew, first
by the bytes that 24 neighbouring windows have in common, then 4, then by whole windows, until each
group fits into an index.

Null and empty texts, and texts shorter than the length, lose nothing. Repeated rows are copies of
each other, so all their windows are repeated; each gives a row. An empty table gives none. Equal strings are all removed, none is a first one, so ties can't occur. Texts of any length are
read whole; columns may have clashing names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, map_slices, materialise

LENGTH = 200
GRAM = 24
#: Bytes of spans in an index; a minimizer's spans stay together.
INDEX_BYTES = 1_000_000
#: Different spans of a minimizer (or of a part of one) in an index, at most; more are split.
INDEX_SPANS = 2_000
#: Bytes of a text hashed at once, so positions fit into the low bits of a key.
CHUNK = 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)


class RollingHash:
    """Hashes of all substrings of one length: polynomial modulo 2^64, then mixed."""

    def __init__(self, longest: int = CHUNK + 2 * LENGTH):
        inverse = pow(_BASE, -1, 1 << 64)
        self.power = self._powers(_BASE, longest + 1)
        self.inverse = self._powers(inverse, longest + 1)

    @staticmethod
    def _powers(base: int, count: int) -> np.ndarray:
        out = np.full(count, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def __call__(self, raw: np.ndarray, size: int) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.power[: len(raw)], out=sums[1:])
        found = (sums[size:] - sums[:-size]) * self.inverse[: len(raw) - size + 1]
        found ^= found >> np.uint64(32)
        found *= _MIX
        found ^= found >> np.uint64(29)
        return found


def minimizer_spans(text: bytes, rolling: RollingHash, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer hash, first window and number of windows of each span of a text."""
    parts = []
    for at in range(0, max(0, len(text) - length + 1), CHUNK):
        raw = np.frombuffer(text[at : at + CHUNK + length - 1], np.uint8).astype(np.uint64)
        hashes = rolling(raw, gram)
        bits = np.uint64(21)
        least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        width, size = length - gram + 1, 1
        while size * 2 <= width:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        place = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        parts.append((hashes[place[first]], first + at, np.diff(np.concatenate((first, [len(place)])))))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def suffix_array(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined text (a byte 255 after each span), its suffix array, and the ranks. Suffixes are
    compared up to the end of their span; the ends themselves rank by position."""
    text = np.frombuffer(b"\xff".join(spans) + b"\xff", np.uint8)
    n, first = len(text), 5
    wide, key = np.concatenate((text, np.zeros(first, np.uint8))), np.zeros(n, np.uint64)
    open_ = np.ones(n, bool)  # no end yet among the bytes taken
    for k in range(first):
        here = wide[k : k + n]
        key = (key << np.uint64(8)) | np.where(open_, here, 0).astype(np.uint64)
        open_ &= here != 255
    order = sorted_places(key, 8 * first)
    now, ended = key[order], ~open_[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([True], (now[1:] != now[:-1]) | ended[1:]))) - 1
    size, bits = first, max(1, n.bit_length())
    while rank[order[-1]] < n - 1:
        key = rank.astype(np.uint64) << np.uint64(bits)
        if size < n:
            key[: n - size] |= rank[size:].astype(np.uint64)
        order = sorted_places(key, 2 * bits)
        now = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(now[1:] != now[:-1])))
        size *= 2
    return text, order, rank


def sorted_places(key: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of the key, then of place. Where both fit into 64 bits they are sorted as one number,
    which is much faster."""
    own = max(1, (len(key) - 1).bit_length())
    if bits + own > 64:
        return np.argsort(key, kind="stable")
    packed = (key << np.uint64(own)) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << own) - 1)).astype(np.int64)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, counted up to ``most`` and to an end of span."""
    padded = np.concatenate((text, np.full(most + 8, 255, np.uint8)))
    length, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(most):
        x, y = padded[a[live] + k], padded[b[live] + k]
        live = live[(x == y) & (x != 255)]
        if not len(live):
            break
        length[live] = k + 1
    return length


class RunIndex:
    """Run-compressed transform of some spans, with the suffixes at both ends of each run."""

    def __init__(self, spans: list[bytes]):
        self.text, self.order, _ = suffix_array(spans)
        before = np.where(self.order > 0, self.text[self.order - 1], 255)
        # the byte before the first byte of a span is an end, and ends are all different
        change = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 255)))
        self.heads = np.flatnonzero(change)
        self.tails = np.concatenate((self.heads[1:] - 1, [len(self.order) - 1]))

    def matches(self, most: int) -> np.ndarray:
        """For each place of the text the length (up to about ``most``) of its longest match elsewhere."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for ends, step in ((self.heads, -1), (self.tails, 1)):
            ends = ends[(ends + step >= 0) & (ends + step < n)]
            at, other = self.order[ends], self.order[ends + step]
            reach = np.zeros(n, np.int64)
            reach[at] = at + common_prefix(self.text, at, other, most)
            np.maximum(best, np.maximum.accumulate(reach) - np.arange(n), out=best)
        return best


def repeated_windows(spans: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some different spans the windows (by offset) that occur more than once among them all."""
    longest = max(map(len, spans))
    good = RunIndex(spans).matches(longest) >= length
    out, at = [], 0
    for s in spans:
        out.append(np.flatnonzero(good[at : at + len(s) - length + 1]))
        at += len(s) + 1
    return out


def as_ranges(offsets: np.ndarray) -> list[int]:
    """first, count, first, count, ... of ascending numbers."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) > 1)
    first = offsets[np.concatenate(([0], cut + 1))]
    last = offsets[np.concatenate((cut, [len(offsets) - 1]))]
    return np.stack((first, last - first + 1), 1).ravel().tolist()


def _spans(packed: DataFrame, length: int) -> DataFrame:
    """Row per span: row, grp (minimizer), kind (hash of the whole span), start, n (windows), times (equal spans from there on)."""

    def make():
        rolling, unpack = RollingHash(), zstandard.ZstdDecompressor().decompress

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], [], []]
            for row, text in zip(batch.column(0).to_numpy(), map(unpack, batch.column(1).to_pylist())):
                group, start, count = minimizer_spans(text, rolling, length)
                if not len(group):
                    continue
                kind = np.array([xxhash.xxh64_intdigest(text[a:b]) for a, b in zip(start.tolist(), (start + count + length - 1).tolist())], np.uint64)
                first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]) | (count[1:] != count[:-1]))))
                times = np.diff(np.concatenate((first, [len(group)])))
                for c, v in zip(cols, (np.full(len(first), row), group[first].view(np.int64), kind[first].view(np.int64), start[first], count[first], times)):
                    c.append(v)
            kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
            arrays = [pa.array((np.concatenate(c) if c else np.zeros(0)).astype(k)) for c, k in zip(cols, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["row", "grp", "kind", "start", "n", "times"])

        return apply

    return map_slices(packed, make, "row long, grp long, kind long, start int, n int, times int")


def _pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number of its own for each row), id, and the text compressed, so that it is cheap to shuffle."""
    rows = as_bytes(docs, text_col, id_col).withColumn("row", F.monotonically_increasing_id()).select("row", text_col, id_col)

    def make():
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t) for t in batch.column(1).to_pylist()], pa.binary()), batch.column(2)], names=["row", "packed", id_col])

        return apply

    return map_slices(rows, make, f"row long, packed binary, {id_col} {rows.schema[id_col].dataType.simpleString()}")


def _cut_out(packed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted spans: grp, kind, hot, span."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("grp", "kind", "start", "n", "hot")).alias("wanted"))

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            group, kind, hot, spans = [], [], [], []
            for text, want in zip(map(unpack, batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                for w in want:
                    group.append(w["grp"])
                    kind.append(w["kind"])
                    hot.append(w["hot"])
                    spans.append(text[w["start"] : w["start"] + w["n"] + length - 1])
            return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(kind, pa.int64()), pa.array(hot, pa.bool_()), pa.array(spans, pa.binary())], names=["grp", "kind", "hot", "span"])

        return apply

    joined = packed.select("row", "packed").join(lists, "row").select("packed", "wanted")
    return map_slices(joined, make, "grp long, kind long, hot boolean, span binary")


def _indexed(pieces: DataFrame, length: int) -> DataFrame:
    """grp, kind, ranges (of repeated windows, from the span's start), from indexes of whole groups; a group is what has one ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = [as_ranges(x + h[3]) for x, h in zip(repeated_windows([h[4] for h in held], length), held)] if held else []
            keep = [i for i, x in enumerate(found) if x]
            return pa.RecordBatch.from_arrays([pa.array([held[i][1] for i in keep], pa.int64()), pa.array([held[i][2] for i in keep], pa.int64()), pa.array([found[i] for i in keep], pa.list_(pa.int32()))], names=["grp", "kind", "ranges"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= INDEX_BYTES and held[-1][:2] != row[:2]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield flush()

    return pieces.select("part", "grp", "kind", "at", "piece").repartition("part", "grp").sortWithinPartitions("part", "grp").mapInArrow(run, "grp long, kind long, ranges array<int>")


def _blocks(pieces: DataFrame, length: int, size: int) -> DataFrame:
    """Cuts pieces of spans into blocks of neighbouring windows, at places fixed to the minimizer.

    ``whole`` is the hash of all bytes of the block's windows, ``core`` that of the bytes that every
    window of such a block has; ``lead`` is the minimizer's place from the piece's first byte.
    """

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8)]
        hash_of = xxhash.xxh64_intdigest
        for group, kind, at, lead, piece in zip(*[c.to_pylist() for c in batch.columns]):
            n, first = len(piece) - length + 1, 0
            while first < n:
                block = (lead - first) // size
                last = min(n, lead - block * size + 1)  # windows whose distance to the minimizer has this quotient
                core = lead - block * size
                own = piece[first : last + length - 1]
                shape = f"{group}:{block}".encode()
                row = (
                    group, kind, at + first, lead - first, last - first, own,
                    hash_of(shape + f":{lead - first}:{last - first}:".encode() + own) >> 1, hash_of(shape + b":" + piece[core : core - size + 1 + length]) >> 1,
                )
                for c, v in zip(cols, row):
                    c.append(v)
                first = last
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["grp", "kind", "at", "lead", "n", "piece", "whole", "core"])

    return map_slices(pieces.select("grp", "kind", "at", "lead", "piece"), lambda: apply, "grp long, kind long, at int, lead int, n int, piece binary, whole long, core long")


def _leads(spans: DataFrame, length: int) -> DataFrame:
    """Whole spans as pieces, with the place of their minimizer."""

    def make():
        rolling = RollingHash(8 * LENGTH)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            leads = []
            for span in batch.column(2).to_pylist():
                hashes = rolling(np.frombuffer(span[:length], np.uint8).astype(np.uint64), GRAM)
                leads.append(int(np.argmin(hashes >> np.uint64(21))))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([0] * len(leads), pa.int32()), pa.array(leads, pa.int32()), batch.column(2)], names=["grp", "kind", "at", "lead", "piece"])

        return apply

    return map_slices(spans.select("grp", "kind", "span"), make, "grp long, kind long, at int, lead int, piece binary")


def _split(spans: DataFrame, length: int, most: int, sizes: tuple[int, ...] = (24, 4, 1)) -> DataFrame:
    """As _indexed, for minimizers with more different spans than fit into an index.

    Spans are cut into blocks of windows. Equal windows lie in blocks with equal cores, so the blocks of one core
    make a group; blocks that are equal as a whole are repeated, and one of them stands for all. A
    group that is still too large is cut into smaller blocks; blocks of one window are equal if their cores are.
    """
    rows, found = _leads(spans, length), []
    for size in sizes:
        blocks = materialise(_blocks(rows, length, size))
        whole = blocks.groupBy("grp", "whole").agg(F.count("*").alias("c"), F.min("kind").alias("first")).where("c > 1").drop("c")
        known = blocks.join(whole, ["grp", "whole"], "left")
        found.append(known.where("first IS NOT NULL").select("grp", "kind", F.array("at", "n").alias("ranges")))
        one = known.where("first IS NULL OR kind = first")
        cores = materialise(one.groupBy("grp", "core").agg(F.count("*").alias("members")).where("members > 1"))
        one = materialise(one.join(cores, ["grp", "core"]))
        found.append(_indexed(one.where(F.col("members") <= most).withColumnRenamed("core", "part"), length))
        rows = one.where(F.col("members") > most)
    return reduce(DataFrame.unionByName, found)


def _removed(packed: DataFrame, ranges: DataFrame, length: int, id_col: str) -> DataFrame:
    lists = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "ranges")).alias("found"))
    joined = packed.join(lists, "row", "left").select("packed", "found", id_col)

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for text, found in zip(map(unpack, batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                spans: list[list[int]] = []
                for a, n in sorted((f["start"] + a, n) for f in found or () for a, n in zip(f["ranges"][::2], f["ranges"][1::2])):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], a + n + length - 1)
                    else:
                        spans.append([a, a + n + length - 1])
                kept, done = [], 0
                for a, b in spans:
                    kept.append(text[done:a])
                    done = b
                kept.append(text[done:])
                rest = b"".join(kept)
                for c, v in zip(cols, (len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [x for s in spans for x in s])):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([batch.column(2), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

        return apply

    kind = packed.schema[id_col].dataType.simpleString()
    return map_slices(joined, make, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, index_spans: int = INDEX_SPANS) -> DataFrame:
    """Row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets start, end, ...)."""
    packed = materialise(_pack(docs, id_col, text_col))
    spans = _spans(packed.select("row", "packed"), length)
    # a table of its own, so that the join below has plain sides and Spark can split a hot minimizer
    often = materialise(spans.groupBy("grp").agg(F.sum("times").alias("c")).where("c > 1").select("grp"))
    again = materialise(spans.join(often, "grp", "left_semi").withColumn("place", F.monotonically_increasing_id()))
    kinds = materialise(again.groupBy("grp", "kind").agg(F.sum("times").alias("copies"), F.min("place").alias("first")))
    groups = materialise(kinds.groupBy("grp").agg(F.count("*").alias("kinds")))
    known = materialise(again.join(materialise(kinds.join(groups, "grp")), ["grp", "kind"]))
    whole = known.where("copies > 1").select("row", "start", F.array(F.lit(0), (F.col("n") * F.col("times")).cast("int")).alias("ranges"))
    wanted = known.where("kinds > 1 AND place = first").withColumn("hot", F.col("kinds") > index_spans)
    cut = materialise(_cut_out(packed, wanted, length))
    part = _indexed(cut.where("NOT hot").select(F.lit(0).cast("long").alias("part"), "grp", "kind", F.lit(0).alias("at"), F.col("span").alias("piece")), length)
    if not cut.where("hot").isEmpty():
        part = part.unionByName(_split(cut.where("hot"), length, max(1, index_spans)))
    single = known.where("copies = 1").join(part, ["grp", "kind"]).select("row", "start", "ranges")
    return _removed(packed, whole.unionByName(single), length, id_col)
