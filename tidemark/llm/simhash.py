"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 16 four-bit segments. The Manhattan
distance of two embeddings never exceeds the Hamming distance, so fingerprints within two bits of
each other have embeddings at most two apart, and then share a grid cell that is at most one step
from either. Every distinct fingerprint enters its own cell and the at most 32 cells one step
away; cells with one fingerprint are dropped. What is left is verified exactly: two fingerprints
of a cell are within two bits of each other if and only if flipping at most one bit of each gives
the same word, so each enters the words one flip away that fall into the cell (one word has at
most 65 fingerprints). No pairs of a group are made, and equal fingerprints count once.

Null and empty texts, and texts without words, have fingerprint zero and are linked like any
other. Repeated rows each give a row, an empty table none. Where an id is null, the component takes its least id; a component of
null ids only has none. Texts of any length are read whole, ties of a bit (set in half of the hashes) give 0, and columns may have clashing names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.llm.common import as_bytes, map_slices, materialise, slices
from tidemark.llm.components import components

SEED = 42
SEGMENTS = 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    plain, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hash_of(plain, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: len(words) - size + 1].tolist()
    return np.array([hash_of(plain[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes. Signed, as Spark keeps it."""
    if not len(hashes):
        return 0
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Row per document: id, fp (long)."""

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[id_col, "fp"])

    rows = as_bytes(docs, text_col, id_col)
    return map_slices(rows, lambda: apply, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, fp long")


def _nibble_counts(half: Column) -> Column:
    """Bit counts of the eight four-bit segments of a 32-bit number, one in each four bits."""
    pairs = half.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))
    return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x33333333))


def embedding(fp: Column) -> Column:
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return _nibble_counts(low) + F.shiftleft(_nibble_counts(high), 32)


def _cells(fps: DataFrame) -> DataFrame:
    """Each fingerprint in the cells at most one step from its embedding: fp, cell, seg, step."""
    at = fps.select("fp", embedding(F.col("fp")).alias("own"))
    steps = ["named_struct('cell', own, 'seg', 0, 'step', 0)"]
    for i in range(SEGMENTS):
        count = f"(shiftrightunsigned(own, {4 * i}) & 15L)"
        steps.append(f"if({count} < 4, named_struct('cell', own + {1 << 4 * i}L, 'seg', {i}, 'step', 1), null)")
        steps.append(f"if({count} > 0, named_struct('cell', own - {1 << 4 * i}L, 'seg', {i}, 'step', -1), null)")
    return at.select("fp", F.explode(F.array_compact(F.array(*map(F.expr, steps)))).alias("s")).select("fp", "s.cell", "s.seg", "s.step")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one fingerprint has, with the least of them."""
    return rows.groupBy(key).agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where(F.col("least") < F.col("most")).select(key, "least")


def links(fps: DataFrame) -> DataFrame:
    """Edges u, v between distinct fingerprints (column fp): those within two bits are connected by them,
    and all that they connect are."""
    cells = _cells(fps)
    near = cells.join(_shared(cells, "cell").select("cell"), "cell", "left_semi")
    flips = F.expr(
        "if(step = 0, array(fp), array_compact(array("
        + ", ".join(f"if((shiftrightunsigned(fp, seg * 4 + {b}) & 1L) = if(step = 1, 0L, 1L), fp ^ shiftleft(1L, seg * 4 + {b}), null)" for b in range(4))
        + ")))"
    )
    words = materialise(near.select("fp", F.explode(flips).alias("word")))
    return words.join(materialise(_shared(words, "word")), "word").where(F.col("fp") != F.col("least")).select(F.col("fp").alias("u"), F.col("least").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Row per document: id, fingerprint (16 hex digits), component_id (least id reachable over links of at most two bits)."""
    rows = materialise(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    found = components(links(distinct))
    ids = found.join(distinct.withColumnRenamed("fp", "node"), "node")
    least = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = found.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    by_fp = materialise(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")))
    return rows.join(by_fp, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Rows and bytes of text in a slice, whose shingles travel packed together, at most (a single text may be longer).
SLICE_TEXTS, SLICE_BYTES = 2048, 2_000_000
#: Shingles whose holders are counted in one task, about.
PART_SHINGLES = 500_000
#: A shingle that more texts of a slice have travels once for the slice, with its number of texts.
FREQUENT = 8
#: Shingles that one task compares, about; a text counts as TEXT_COST more.
BLOCK_SHINGLES, TEXT_COST = 1_000_000, 50
#: Rounds in which large groups are thinned around a head before what is left is compared in pairs of parts.
THINNINGS = 4


def _digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _node(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _prefix(size: int, least: float) -> int:
    """So many of the first shingles of a text, in an order of all shingles, that a similar text has one of them among its own."""
    return size - math.ceil(least * size - 1e-9) + 1


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def similar_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of sets of at least that similarity that connect all that such pairs connect; sets without members are alike."""
    sizes, found, label = np.array([len(s) for s in sets], np.int64), [], np.arange(len(sets))

    def link(x: int, y: int) -> None:
        if label[x] != label[y]:
            found.append((x, y))
            label[label == label[y]] = label[x]

    bare = np.flatnonzero(sizes == 0).tolist()
    for y in bare[1:]:
        link(bare[0], y)
    if len(bare) == len(sets):
        return found
    owner, offsets = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes) - sizes
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))  # rare ones first
    token = rank[token]
    token = token[np.lexsort((token, owner))]
    prefix = np.array([_prefix(n, least) if n else 0 for n in sizes.tolist()], np.int64)
    first = np.arange(len(owner)) - offsets[owner] < prefix[owner]
    by_token = np.argsort(token[first], kind="stable")
    holders, held = owner[first][by_token], np.searchsorted(token[first][by_token], np.arange(len(counts) + 1))
    mine = np.zeros(len(counts), bool)
    for x in np.flatnonzero(sizes).tolist():
        own = token[offsets[x] : offsets[x] + sizes[x]]
        head = own[: prefix[x]]
        near = np.unique(holders[_spread(held[head], held[head + 1] - held[head])])
        near = near[(near > x) & (label[near] != label[x])]
        near = near[np.minimum(sizes[near], sizes[x]) >= least * np.maximum(sizes[near], sizes[x]) - 1e-9]
        if len(near):
            mine[own] = True
            both = np.add.reduceat(mine[token[_spread(offsets[near], sizes[near])]].astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            mine[own] = False
            for y in near[both / (sizes[near] + sizes[x] - both) >= least].tolist():
                link(x, y)
    return found


def _features(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, key (digest of the text), node (its first eight bytes), fp and size (distinct shingles) of each row."""

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, fps, sizes = [], [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(text, shingle)
            keys.append(_digest(text))
            fps.append(fingerprint(hashes))
            sizes.append(len(np.unique(hashes)))
        arrays = [pa.array(keys, pa.binary()), pa.array(map(_node, keys), pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "key", "node", "fp", "size"])

    return map_slices(as_bytes(docs, text_col, id_col), lambda: apply, "id long, key binary, node long, fp long, size long")


# Packed rows: of a slice (texts: its nodes, sizes, numbers of counted shingles, further shingles of small texts) or of
# some counted shingles of a slice (hashes, owner in the slice or -1, number of texts).
_PACKED = "part int, slice long, texts binary, hashes binary, owners binary, counts binary"
_OWN = np.dtype([("node", "<i8"), ("size", "<i4"), ("counted", "<i4"), ("further", "<i4")])


def _counted(hashes: np.ndarray) -> np.ndarray:
    """Shingles whose holders are counted: half of all."""
    return (hashes & np.uint64(1)) == 0


def _text_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            if held and (len(held) >= SLICE_TEXTS or size + len(text) > SLICE_BYTES):
                yield held
                held, size = [], 0
            held.append(text)
            size += len(text)
    if held:
        yield held


def _pack_shingles(docs: DataFrame, text_col: str, shingle: int, least: float, parts: int) -> DataFrame:
    """The shingles of every slice of texts, by part of the hashes' range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _text_slices(batches):
            distinct = sorted(set(held))
            keys = [_digest(t) for t in distinct]
            sets = [np.unique(shingle_hashes(t, shingle)) for t in distinct]
            own = np.zeros(len(sets), _OWN)
            own["node"], own["size"] = [_node(k) for k in keys], [len(s) for s in sets]
            counted = [s[_counted(s)] for s in sets]
            own["counted"] = [len(c) for c in counted]
            # of a text with few counted shingles the prefix goes on with others, in the order of their hashes
            further = [s[~_counted(s)][: max(0, _prefix(len(s), least) - len(c))] if len(s) else np.zeros(1, np.uint64) for s, c in zip(sets, counted)]
            own["further"] = [len(f) for f in further]
            here = xxhash.xxh64_intdigest(b"".join(keys)) >> 1
            flat = np.concatenate(counted)
            owner = np.repeat(np.arange(len(sets), dtype=np.int16), own["counted"])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate((starts, [len(flat)])))
            often = np.repeat(times > FREQUENT, times)
            # what many texts have: in the slice's own row with all holders, elsewhere once
            once = np.zeros(len(flat), bool)
            once[starts[times > FREQUENT]] = True
            sent = ~often | once
            number = np.where(once, np.repeat(times, times), 1).astype(np.int32)[sent]
            hashes, holder = flat[sent], np.where(often, -1, owner)[sent].astype(np.int16)
            rows = [(here % parts, here, own.tobytes(), np.concatenate((flat[often], *further)).tobytes(), owner[often].tobytes(), b"")]
            part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cut = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[p], cut[p + 1]
                rows.append((p, here, b"", hashes[a:b].tobytes(), holder[a:b].tobytes(), number[a:b].tobytes()))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "slice", "texts", "hashes", "owners", "counts"])

    return as_bytes(docs, text_col).mapInArrow(run, _PACKED)


def _count_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the numbers of texts in a slice by those in all slices, and drops shingles of one text. A task has all rows
    of its parts; a shingle has at most FREQUENT entries a slice there."""
    names = ["part", "slice", "texts", "hashes", "owners", "counts"]
    slices_, hashes, owners, counts = [], [], [], []
    for batch in batches:
        of_slice = pa.array([len(t) > 0 for t in batch.column(2).to_pylist()], pa.bool_())
        yield batch.filter(of_slice)
        for part, here, text, h, o, c in zip(*[x.to_pylist() for x in batch.columns]):
            if not text:
                slices_.append(here)
                hashes.append(np.frombuffer(h, np.uint64))
                owners.append(np.frombuffer(o, np.int16))
                counts.append(np.frombuffer(c, np.int32))
    if not slices_:
        return
    sizes = np.array([len(h) for h in hashes])
    flat, number = np.concatenate(hashes), np.concatenate(counts)
    del hashes, counts
    order = np.argsort(flat)
    ordered = flat[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    totals = np.add.reduceat(number[order].astype(np.int64), starts)
    total = np.empty(len(flat), np.int64)
    total[order] = np.repeat(totals, np.diff(np.concatenate((starts, [len(flat)]))))
    ends = np.cumsum(sizes)
    for here, a, b, o in zip(slices_, (ends - sizes).tolist(), ends.tolist(), owners):
        keep = total[a:b] > 1
        if keep.any():
            row = (0, here, b"", flat[a:b][keep].tobytes(), o[keep].tobytes(), np.minimum(total[a:b][keep], 2**31 - 1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int32(), pa.int64(), *[pa.binary()] * 4])], names=names)


def _slice_prefixes(own: np.ndarray, packed: bytes, owners: bytes, shared: list[tuple[bytes, bytes, bytes]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The shared shingles of the prefixes of a slice's texts, rarest first, and the nodes they belong to."""
    values = np.frombuffer(packed, np.uint64)
    often_owner = np.frombuffer(owners, np.int16)
    often, further = values[: len(often_owner)], values[len(often_owner) :]
    hashes = np.concatenate([np.frombuffer(h, np.uint64) for h, _, _ in shared] or [np.zeros(0, np.uint64)])
    owner = np.concatenate([np.frombuffer(o, np.int16) for _, o, _ in shared] or [np.zeros(0, np.int16)]).astype(np.int64)
    count = np.concatenate([np.frombuffer(c, np.int32) for _, _, c in shared] or [np.zeros(0, np.int32)]).astype(np.int64)
    whole = owner < 0
    known, at = np.unique(hashes[whole], return_index=True)
    if len(often):
        often_count = count[whole][at][np.searchsorted(known, often)]
        hashes, owner, count = np.concatenate((hashes[~whole], often)), np.concatenate((owner[~whole], often_owner)), np.concatenate((count[~whole], often_count))
    order = np.lexsort((hashes, count, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))) if len(owner) else np.zeros(0, bool)
    hashes, owner = hashes[first], owner[first]  # equal slices come together
    number = np.bincount(owner, minlength=len(own))
    prefix = np.array([_prefix(n, least) if n else 0 for n in own["size"].tolist()], np.int64)
    take = np.clip(prefix - (own["counted"] - number), 0, number)
    place = np.arange(len(owner)) - (np.cumsum(number) - number)[owner]
    kept = place < take[owner]
    more = np.repeat(np.arange(len(own)), own["further"])
    return np.concatenate((hashes[kept], further)), own["node"][np.concatenate((owner[kept], more)).astype(np.int64)]


def _prefixes(docs: DataFrame, text_col: str, shingle: int, least: float, shingles: int) -> DataFrame:
    """token, node: of each text the shared ones among its first shingles, in an order of all shingles by how many texts have them.

    Two similar texts share one. Only half of the shingles are counted, and come first in the order.
    """
    parts = max(1, math.ceil(shingles / 2 / PART_SHINGLES))
    # a part a task; hashes of part numbers would put several into one
    packed = _pack_shingles(docs, text_col, shingle, least, parts).repartitionById(parts, F.col("part"))
    counted = materialise(packed.mapInArrow(_count_holders, _PACKED))

    def pick_first(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["texts"])
        tokens, nodes = _slice_prefixes(np.frombuffer(own["texts"], _OWN), own["hashes"], own["owners"], [(r["hashes"], r["owners"], r["counts"]) for r in rows if not r["texts"]], least)
        return pa.table({"token": pa.array(tokens.view(np.int64)), "node": pa.array(nodes.astype(np.int64))})

    return counted.groupBy("slice").applyInArrow(pick_first, "token long, node long")


def _unpacked(column: pa.Array, shingle: int) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.unique(shingle_hashes(unpack(t), shingle)) for t in column.to_pylist()]


def _member_texts(docs: DataFrame, text_col: str, members: DataFrame) -> DataFrame:
    """members with their texts, compressed; one row a text."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        return pa.RecordBatch.from_arrays([pa.array(map(_digest, texts), pa.binary()), pa.array(map(squeeze, texts), pa.binary())], names=["key", "packed"])

    rows = map_slices(as_bytes(docs, text_col), lambda: pack, "key binary, packed binary").join(members.select("key"), "key", "left_semi")
    return rows.groupBy("key").agg(F.first("packed").alias("packed")).join(members, "key")


def _cost() -> Column:
    return F.sum(F.col("size") + TEXT_COST)


def _thinned(texts: DataFrame, shingle: int, least: float) -> tuple[DataFrame, DataFrame | None]:
    """Thins roots that are too large for one task, and the edges found by that.

    Every text of such a root is compared with a head. The distance 1 - similarity is a metric: a text at
    distance d of the head, d within the limit, has only partners nearer than d + limit. Where no text lies
    between the limit and that, all of its partners are linked to the head as it is, and it needs no further comparison.
    """
    limit, found = 1 - least, []
    for _ in range(THINNINGS):
        large = texts.groupBy("root").agg(_cost().alias("cost"), F.min("key").alias("head")).where(F.col("cost") > BLOCK_SHINGLES).select("root", "head")
        large = materialise(large.join(texts.select(F.col("key").alias("head"), F.col("packed").alias("head_packed")), "head"))
        if large.isEmpty():
            break

        def distance(batch: pa.RecordBatch) -> pa.RecordBatch:
            heads, out = {}, []
            for text, head in zip(_unpacked(batch.column(3), shingle), batch.column(4).to_pylist()):
                if head not in heads:
                    heads = {head: _unpacked(pa.array([head], pa.binary()), shingle)[0]}
                own = heads[head]
                both = len(np.intersect1d(text, own, assume_unique=True))
                out.append(1 - both / (len(text) + len(own) - both) if len(text) + len(own) else 0.0)
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.float64())], names=["key", "root", "head", "d"])

        beside = texts.join(large, "root").select("key", "root", "head", "packed", "head_packed")
        measured = materialise(map_slices(beside, lambda: distance, "key binary, root long, head binary, d double"))
        linked = F.col("d") <= limit + 1e-12
        found.append(measured.where(linked & (F.col("key") != F.col("head"))).select("key", "head"))
        beyond = measured.where(~linked).groupBy("root").agg(F.min("d").alias("beyond"))
        done = measured.join(beyond, "root", "left").where(linked & ((F.col("d") < F.col("beyond") - limit - 1e-9) | F.col("beyond").isNull() | (F.col("key") == F.col("head")))).select("key")
        texts = materialise(texts.join(done, "key", "left_anti"))
    edges = None
    for f in found:
        edges = f if edges is None else edges.unionByName(f)
    return texts, edges


def _similar(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Edges key, head between texts of at least that similarity, enough to connect all that they connect.

    ``texts`` has key, root, size and packed. Texts of one root are compared in one task, those of several
    small roots together; a root too large for that is thinned, and of what is left each pair of parts has a task.
    """
    texts, edges = _thinned(texts, shingle, least)
    totals = texts.groupBy("root").agg(F.ceil(_cost() / BLOCK_SHINGLES).alias("parts"))
    bins = 1 + int((texts.agg(_cost()).first()[0] or 0) // BLOCK_SHINGLES)
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    dealt = texts.join(totals, "root").select(
        "key", "packed", F.when(F.col("parts") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))).alias("block"), (F.col("parts") > 1).alias("cut"),
        part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("with"),
    )
    dealt = dealt.select("key", "packed", "block", "cut", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))

    def apply(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        pairs = similar_forest(_unpacked(table.column("packed"), shingle), least)
        return pa.table({"key": pa.array([keys[a] for a, _ in pairs], pa.binary()), "head": pa.array([keys[b] for _, b in pairs], pa.binary())})

    compared = dealt.groupBy("block", "cut", "i", "j").applyInArrow(apply, "key binary, head binary")
    return compared if edges is None else compared.unionByName(edges)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows and columns of ``docs`` with one row of each group of near-duplicates: the least id, one of repeated rows.

    Candidates are texts whose SimHash fingerprints are linked (two bits, through the embedding), and,
    as that finds few texts of a similarity near 0.8, texts that share one of their rarest shingles, as all
    similar ones do. What candidates connect is compared exactly. A null id counts as the largest; empty
    texts, and texts without words, are alike; an empty table stays empty. Columns may have clashing names.
    """
    last = 2**63 - 1
    features = materialise(_features(docs, id_col, text_col, shingle).withColumn("id", F.coalesce("id", F.lit(last))))
    nodes = materialise(features.groupBy("key").agg(F.min("id").alias("id"), *[F.min(c).alias(c) for c in ("node", "fp", "size")]))
    by_fp = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    linked = links(nodes.select("fp").distinct())
    bits = linked.join(by_fp.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(by_fp.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v").select("a", "b")
    same = nodes.join(by_fp, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    prefixes = materialise(_prefixes(docs, text_col, shingle, least, features.agg(F.sum("size")).first()[0] or 0).distinct())
    holders = materialise(prefixes.groupBy("token").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("token", "b"))
    rare = prefixes.join(holders, "token").select(F.col("node").alias("a"), "b")
    candidates = bits.unionByName(same).unionByName(rare).where("a != b").distinct()
    roots = components(candidates.select(F.col("a").alias("u"), F.col("b").alias("v")))
    members = materialise(nodes.join(roots, "node").select("key", "root", "size"))
    good = materialise(_similar(materialise(_member_texts(docs, text_col, members)), shingle, least))
    groups = components(good.select(F.col("key").alias("u"), F.col("head").alias("v")))
    ids = groups.join(nodes.select(F.col("key").alias("node"), "id"), "node")
    best = ids.groupBy("root").agg(F.min(F.struct("id", "node")).alias("best"))
    gone = ids.join(best, "root").where(F.col("node") != F.col("best.node")).select(F.col("node").alias("key"))
    stay = nodes.select("key", "id").join(gone, "key", "left_anti")

    columns, text_at, id_at = docs.columns, docs.columns.index(text_col), docs.columns.index(id_col)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [_digest((t or "").encode()) for t in batch.column(text_at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "_key"])

    plain = docs.toDF(*[f"_c{i}" for i in range(len(columns))])
    keyed = map_slices(plain, lambda: digest, StructType([*plain.schema.fields, StructField("_key", BinaryType())])).withColumn("_id", F.coalesce(f"_c{id_at}", F.lit(last)))
    kept = keyed.join(stay.select(F.col("key").alias("_key"), F.col("id").alias("_id")), ["_key", "_id"], "left_semi")
    if not features.groupBy("key", "id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_key", "_id"])
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
