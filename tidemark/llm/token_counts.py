"""Token counts by section, attributed through offsets.

A document is encoded once as a whole. Token character spans are joined with the spans of its
sections (lines, each with its line break). Rule for a token that crosses a boundary: it belongs
whole to the section that holds its first byte, so the sections' counts sum to the document's.

Null and empty texts have no tokens and no sections. Repeated rows each give a row, an empty table none; columns may
have clashing names. Texts of any length are encoded whole, long runs of white space too. Every row is counted by itself, so ties can't occur.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tidemark.llm.bpe import PIECES
from tidemark.llm.common import as_bytes, map_slices


#: White space of at least this many characters is given to the encoder as a piece of its own: its pattern matcher
#: backtracks once a character of such a run.
LONG_RUN = 1000
_LONG_RUN = regex.compile(r"\p{White_Space}{%d,}" % LONG_RUN)  # what the encoder's \s is; Python's has U+001C to U+001F too


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text. In a long run of white space the piece is the run without its last character, or all of it at the end."""
    out, done = [], 0
    for m in _LONG_RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += encoder.encode_ordinary(text[done : m.start()])
        out += encoder._encode_single_piece(text[m.start() : end])
        done = end
    return out + encoder.encode_ordinary(text[done:])


def section_starts(text: bytes) -> np.ndarray:
    """First byte of each line; a final line break opens no further line."""
    raw = np.frombuffer(text, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
    return starts[starts < len(raw)]


def char_offsets(text: bytes) -> np.ndarray:
    """For each byte (and the end) the number of code points that begin before it."""
    raw = np.frombuffer(text, np.uint8)
    return np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))


def attribute(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Section starts, tokens of each, and how many tokens cross a boundary."""
    sections = section_starts(text)
    ends = np.cumsum(lengths)
    own = np.searchsorted(sections, ends - lengths, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    return sections, np.bincount(own, minlength=len(sections)), int((last > own).sum())


def count_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per document: id, n_tokens, n_sections, section_starts (code points), section_tokens, n_crossing."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def make():
        encoder = tiktoken.Encoding("tokens", pat_str=PIECES, mergeable_ranks=ranks.value, special_tokens={})
        length = np.zeros(max(ranks.value.values()) + 1, np.int64)
        for token, i in ranks.value.items():
            length[i] = len(token)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, sections, starts, counts, crossing = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.asarray(encode(encoder, text.decode("utf-8")), np.int64)
                at, n, over = attribute(text, length[ids]) if text else (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
                tokens.append(len(ids))
                sections.append(len(at))
                starts.append(char_offsets(text)[at] if not text.isascii() else at)
                counts.append(n)
                crossing.append(over)
            arrays = [pa.array(tokens, pa.int64()), pa.array(sections, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())), pa.array(crossing, pa.int64())]
            return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, "n_tokens", "n_sections", "section_starts", "section_tokens", "n_crossing"])

        return apply

    rows = as_bytes(docs, text_col, id_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return map_slices(rows, make, f"{id_col} {kind}, n_tokens long, n_sections long, section_starts array<long>, section_tokens array<long>, n_crossing long")
