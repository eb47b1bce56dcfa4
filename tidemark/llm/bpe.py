"""Byte-level BPE encoding and decoding.

A piece is encoded with a heap of (merge rank, position) over a doubly linked list of symbols;
entries whose pair has changed since are stale and skipped. Decoding concatenates the bytes of
the vocabulary strings. Ids equal those of the tokenizers library for the same file.

Null texts are empty; an empty text has no ids. Repeated rows each give a row, an empty table none. Strings of special
tokens in a text become those tokens, as in the library. Of merges of equal rank the leftmost goes first. Texts of any length are encoded whole;
columns may have clashing names. Which characters count as letters and numbers depends on the version of
Unicode, so that is asked of the library's own cutter once, when a tokenizer file is loaded.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from tidemark.llm.common import map_slices, pick

#: Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same, with the letters and numbers of a newer Unicode counted as other characters.
PIECES_WITHOUT = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--[ODD]]+| ?[\p{N}--[ODD]]+| ?(?:[^\s\p{L}\p{N}]|[ODD])+|\s+(?!\S)|\s+"
#: Pieces that each of a worker's two cache generations holds.
CACHED = 250_000
#: Longer pieces are encoded afresh each time.
CACHED_CHARS = 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache
def newer_characters() -> str:
    """Ranges of the characters that ``regex`` takes for letters or numbers and the library's cutter doesn't, as in a character class."""
    known = [c for c in map(chr, range(128, 0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF and regex.match(r"[\p{L}\p{N}]", c)]
    # a letter stays with the letter before it, a number with the number after it
    cuts = {start for _, (start, _) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f"a{c}1" for c in known))}
    odd = [ord(c) for i, c in enumerate(known) if 3 * i + 1 in cuts and 3 * i + 2 in cuts]
    ends = [[c, c] for c in odd[:1]]
    for c in odd[1:]:
        if c == ends[-1][1] + 1:
            ends[-1][1] = c
        else:
            ends.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ends)


def load(path: str) -> dict:
    """Vocabulary bytes by id, merges and special tokens of a tokenizer file; its size is bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for token in spec["added_tokens"]:
        if marks := [m for m in ("single_word", "lstrip", "rstrip", "normalized") if token.get(m)]:
            raise ValueError(f"special token {token['content']!r} has {', '.join(marks)}, which is not supported")
    symbols, vocab = byte_symbols(), spec["model"]["vocab"]
    strings = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings |= {i: s.encode() for s, i in special.items()}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
    first = [0] * 256
    for c, b in symbols.items():
        first[b] = vocab[c]
    return {"strings": [strings.get(i, b"") for i in range(max(strings) + 1)], "merges": merges, "first": first, "special": special, "newer": newer_characters()}


class Codec:
    def __init__(self, model: dict):
        self.strings, self.merges, self.first, self.special = (model[k] for k in ("strings", "merges", "first", "special"))
        self.find = regex.compile(PIECES).findall
        self.newer = re.compile(f"[{model['newer']}]").search if model["newer"] else None
        self.find_without = regex.compile(PIECES_WITHOUT.replace("ODD", model["newer"])).findall if model["newer"] else None
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.young: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def piece_ids(self, piece: bytes) -> list[int]:
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges, heap = self.merges, []
        for i in range(n - 1):
            found = merges.get(ids[i] << 32 | ids[i + 1])
            if found:
                heap.append(found[0] << 40 | i)
        if not heap:
            return ids
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFFFF
            if ids[i] < 0 or (j := right[i]) >= n:
                continue
            found = merges.get(ids[i] << 32 | ids[j])
            if found is None or found[0] != entry >> 40:  # stale
                continue
            ids[i], ids[j] = found[1], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if after := merges.get(ids[i] << 32 | ids[k]):
                    push(heap, after[0] << 40 | i)
            if (k := left[i]) >= 0 and (before := merges.get(ids[k] << 32 | ids[i])):
                push(heap, before[0] << 40 | k)
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def _known(self, piece: str) -> tuple[str, int, bytes]:
        """Ids as text, their number and their decoded bytes."""
        found = self.old.get(piece)
        if found is None:
            ids = self.piece_ids(piece.encode())
            found = ",".join(map(str, ids)), len(ids), self.decode(ids)
            if len(piece) > CACHED_CHARS:
                return found
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, {}
        self.young[piece] = found
        return found

    def encode_pieces(self, text: str) -> list[tuple[str, int, bytes]]:
        out, parts = [], [text]
        names: list[str] = []
        if self.cut and any(s in text for s in self.special):
            parts, names = self.cut.split(text), self.cut.findall(text)
        find = self.find_without if self.newer and not text.isascii() and self.newer(text) else self.find
        for k, part in enumerate(parts):
            out += [self.young.get(p) or self._known(p) for p in find(part)]
            if k < len(names):
                out.append((str(self.special[names[k]]), 1, names[k].encode()))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for s, _, _ in self.encode_pieces(text) for x in s.split(",")]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Row per document: id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids and the decoded text."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(load(model_path))

    def make():
        codec = Codec(model.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                got = codec.encode_pieces(text)
                ids, back = ",".join([g[0] for g in got]), b"".join([g[2] for g in got])
                row = sum([g[1] for g in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()
                for c, v in zip(cols, row + (([int(x) for x in ids.split(",")] if ids else [], back.decode("utf-8", "replace")) if with_ids else ())):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 5 if with_ids else 3]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(kinds)]
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[id_col, *names])

        return apply

    rows = pick(docs, id_col, text_col)
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(rows.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col)), make, schema + (", ids array<int>, decoded string" if with_ids else ""))
