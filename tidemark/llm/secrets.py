"""Secret scans: fixed patterns, and character Markov models for random strings.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers
and words, are trained from labelled samples. Random are generated keys, and values that the fixed patterns find anywhere in the
documents; ordinary are identifiers, paths, dated names, alphabets and compounds of all lengths, built by rule from the words of a public
vocabulary, and the shorter runs of key characters of the documents. Counts cover all documents; either source has half of a model's weight.
A candidate run is a secret where a part of it, of at least LEAST_RUN characters, has a mean log-likelihood ratio
a character over the threshold, which is the least at which only the share ALARMS of held-out ordinary strings is flagged. The span is the whole run if its own mean is, else, of all such parts, the one whose ratios
exceed the threshold by the largest sum (the first of equal ones): so a key glued to words is found.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Repeated rows each
give a row, an empty table none. Texts of any length are scanned whole; columns may have clashing names.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, map_slices, map_whole, slices

# The patterns, and the least length of each kind.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
WORDS = (b"passw", b"secret", b"token", b"api")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Names of the rank files whose words ordinary samples are built from.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Labelled samples of each kind; ordinary ones that set the threshold, and the share of them that may be flagged.
GENERATED, ORDINARY, HELD_OUT, ALARMS = 20_000, 40_000, 8_000, 0.005
#: Runs that the models judge have at least so many characters; the documents' ordinary runs, for training, have fewer but LEAST_WORD.
LEAST_RUN, LEAST_WORD = 16, 4
#: A part with fewer different characters, as a line of one letter, is no key, however rare its pairs are in words.
LEAST_KINDS = 6
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
#: Weight of single-character shares in a pair's.
PRIOR = 20.0

_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(len(ALPHABET))
_WORD = re.compile(rb" [A-Za-z]{2,14}")
SYMBOLS = len(ALPHABET) + 1  # the last is the start of a string


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in bytes."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def transitions(run: bytes) -> np.ndarray:
    """Codes of the character pairs of a run, from its start."""
    codes = np.concatenate(([SYMBOLS - 1], _CODE[np.frombuffer(run, np.uint8)]))
    return codes[:-1] * SYMBOLS + codes[1:]


def generated_keys(count: int = GENERATED, seed: int = 7) -> list[bytes]:
    """Labelled samples of random strings: hex, base 62, base 64 (either alphabet) and upper-case keys of 16 to 64 characters."""
    r = random.Random(seed)
    alphabets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + b"_-", ALPHABET[:26] + ALPHABET[52:62], b"0123456789abcdef"]
    return [bytes(r.choices(a, k=r.randint(16, 64))) for a in alphabets for _ in range(count // len(alphabets))]


def vocabulary_words(paths: list[str]) -> list[str]:
    """Words (2 to 14 letters, lower-cased) of rank files: a token in base 64 and its rank a line."""
    words = set()
    for path in paths:
        with open(path, "rb") as lines:
            for line in lines:
                token = base64.b64decode(line.split()[0])
                if _WORD.fullmatch(token):
                    words.add(token.strip().decode().lower())
    return sorted(words)


def ordinary_strings(words: list[str], count: int = ORDINARY, seed: int = 7) -> list[bytes]:
    """Labelled samples of ordinary strings: words joined as identifiers, constants, paths, dated names and compounds are, some with
    numbers; and alphabets, rows of keys, numbers and UUIDs."""
    r, out = random.Random(seed), []
    for _ in range(count):
        some = [r.choice(words) for _ in range(r.randint(2, 6))]
        if r.random() < 0.25:
            some.insert(r.randint(1, len(some)), r.choice([str(r.randint(0, 99)), str(r.randint(1990, 2030)), str(r.randint(100, 9999)), f"v{r.randint(1, 9)}", f"{r.choice('xufsi')}{r.choice((8, 16, 32, 64, 86, 256))}"]))
        capital = [w[:1].upper() + w[1:] for w in some]
        date = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 31):02d}"
        pairs = [r.choice(("_", "-", "")).join(some[i : i + 2]) for i in range(0, len(some), 2)]
        styles = ["".join([some[0], *capital[1:]]), "".join(capital), "_".join(some), "_".join(some).upper(), "-".join(some), "/" + "/".join(some), "".join(some), "/".join(pairs), "-".join([date, *some])]
        out.append(r.choice(styles))
    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    for row in (lower, upper, string.digits, upper + lower + string.digits + "+/", "qwertyuiop", "asdfghjkl", "zxcvbnm", "QWERTYUIOP", "ASDFGHJKL", "ZXCVBNM"):
        out += [row] * (count // 200)
    for _ in range(count // 40):
        out.append("-".join("".join(r.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)))
        out.append("".join(r.choices(string.digits, k=r.randint(10, 20))))
        out.append(r.choice("=-_/+0x1aA") * r.randint(4, 60))
    return [x.encode() for x in out]


def pair_counts(texts: list[bytes]) -> np.ndarray:
    """Character pairs of ordinary runs (row 0) and of runs in spans of the fixed patterns (row 1) of some texts."""
    joined = b"\n".join(texts)
    codes = _CODE[np.frombuffer(joined, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], codes < len(ALPHABET), [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    spans, at = [], 0
    for text in texts:
        spans += [(s + at, e + at) for s, _, e in base_spans(text)]
        at += len(text) + 1
    low, high = np.array([s for s, _ in spans], np.int64), np.array([e for _, e in spans], np.int64)
    # spans that end at or before the run's start, and those that begin before its end
    secret = np.searchsorted(np.sort(low), ends, "left") > np.searchsorted(np.sort(high), starts, "right")
    size = ends - starts
    label = np.where(secret, np.where(size >= LEAST_RUN, 1, -1), np.where((size >= LEAST_WORD) & (size < LEAST_RUN), 0, -1))
    out = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    before = np.concatenate(([SYMBOLS - 1], codes[:-1]))
    before[starts] = SYMBOLS - 1
    for k in (0, 1):
        first, length = starts[label == k], size[label == k]
        places = np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)
        out[k] = np.bincount(before[places] * SYMBOLS + codes[places], minlength=SYMBOLS * SYMBOLS)
    return out


def train(docs: DataFrame, words: list[str], text_col: str = "text", alarms: float = ALARMS) -> np.ndarray:
    """Log-likelihood ratios of the character pairs (random over ordinary), smoothed towards single characters, less the threshold.

    Pair counts over all documents come from Spark; only two tables of 68 x 68 counts reach the driver.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = pair_counts(batch.column(0).to_pylist())
        label, pair = np.nonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(pair, pa.int64()), pa.array(sums[label, pair], pa.int64())], names=["label", "pair", "n"])

    sums = np.zeros((2, SYMBOLS * SYMBOLS))
    for label, pair, n in map_slices(as_bytes(docs, text_col), lambda: count, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n")).collect():
        sums[label, pair] += n
    for k, sample in enumerate((ordinary_strings(words), generated_keys())):
        own = np.bincount(np.concatenate([transitions(x) for x in sample]), minlength=SYMBOLS * SYMBOLS)
        sums[k] = sums[k] * min(1.0, own.sum() / max(1.0, sums[k].sum())) + own
    given = sums.reshape(2, SYMBOLS, SYMBOLS)
    single = given.sum(1, keepdims=True) + 1.0
    single /= single.sum(2, keepdims=True)
    logs = np.log((given + PRIOR * single) / (given.sum(2, keepdims=True) + PRIOR))
    ratios = (logs[1] - logs[0]).ravel()
    best = sorted(best_mean(ratios[transitions(x)]) for x in ordinary_strings(words, HELD_OUT, seed=8) if len(x) >= LEAST_RUN and CANDIDATE.fullmatch(x))
    return ratios - max(0.0, best[int((1 - alarms) * (len(best) - 1))])


def best_mean(ratios: np.ndarray, least: int = LEAST_RUN) -> float:
    """Largest mean of at least so many consecutive numbers: the threshold from which a string is not flagged."""
    low, high = float(ratios.min()), float(ratios.max())
    for _ in range(20):
        middle = (low + high) / 2
        low, high = (middle, high) if best_part(ratios - middle, least)[0] > 0 else (low, middle)
    return high


def best_part(excess: np.ndarray, least: int = LEAST_RUN) -> tuple[float, int, int]:
    """Largest sum of consecutive numbers, at least so many, with its first and last (exclusive) place."""
    sums = np.concatenate(([0.0], np.cumsum(excess)))
    low = np.minimum.accumulate(sums[: len(sums) - least])
    gain = sums[least:] - low
    end = int(np.argmax(gain))
    return float(gain[end]), int(np.argmin(sums[: end + 1])), end + least


def markov_spans(text: bytes, ratios: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        excess = ratios[transitions(m[0])]
        gain, first, last = best_part(excess)
        if gain > 0:
            if excess.sum() > 0:
                first, last = 0, len(excess)
            if len(set(m[0][first:last])) >= LEAST_KINDS:
                out.append((m.start() + first, 3, m.start() + last))
    return out


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii():
        return spans
    out, at, chars, seen = [], 0, 0, {}
    for b in sorted({x for s, _, e in spans for x in (s, e)}):
        chars, at = chars + len(text[at:b].decode("utf-8")), b
        seen[b] = chars
    for s, k, e in spans:
        out.append((seen[s], k, seen[e]))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per document: id, n_assign, n_access, n_hex, n_markov, base_sha256, spans. ``words`` are those that ordinary samples are built from."""
    ratios = docs.sparkSession.sparkContext.broadcast(train(docs, words, text_col))

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            more = markov_spans(text, ratios.value)
            base, more = (in_code_points(text, x) if x else x for x in (base, more))
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            for c, v in zip(cols, [*n, len(more), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)]):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[id_col, "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    rows = as_bytes(docs, text_col, id_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return map_slices(rows, lambda: apply, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, words: list[str], text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The same rows and columns, each span of the text replaced by a mark; n_chars, if there, follows."""
    ratios = docs.sparkSession.sparkContext.broadcast(train(docs, words, text_col))
    at = docs.columns.index(text_col)
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        raw, out, done = text.encode(), [], 0
        for s, _, e in sorted(base_spans(raw) + markov_spans(raw, ratios.value)):
            if e > done:
                if s >= done:
                    out += [raw[done:s], mark.encode()]
                done = e
        return (b"".join(out) + raw[done:]).decode() if done else text

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [clean(t) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if count_at is not None:
            columns[count_at] = pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column(count_at).to_pylist())], batch.schema.field(count_at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_whole(docs, lambda batches: map(apply, slices(batches)))
