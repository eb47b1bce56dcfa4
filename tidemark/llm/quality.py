"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words and word pairs in a fixed number of buckets), one of
target text (labelled good and not toxic) and one of raw text (all documents), give each document its
log importance: the mean of the log ratios of its n-grams' shares in target and raw text, times a stated
temperature, so that neither length nor the noise alone decides. The target is counted in five folds by a hash of the text, and a
text is scored by the folds that it is not in, so that a fitted row does not recognise itself (or its copies) and scores like an unseen one.
A sample of given size is drawn by Gumbel top-k: the k largest sums of log importance and Gumbel noise,
which comes from a hash of the id; equal keys go by the smaller id, rows equal in both all stay.

Beside it stands the evidence against the target, so that length or an unusual topic do not sink a
document: the sum, over its distinct n-grams (words, pairs, word shapes, shape
pairs, marks of repetition), of those log ratios of labelled target rows over all labelled rows that
speak clearly against the target. The threshold is set on held-out labelled rows; ``keep`` and ``accepted`` go by it alone.

``drawn``, the pipeline's stage, is the resampling with both: the log importance of a document is its mean log ratio, times a
lower temperature, plus its evidence, whose n-grams are few among the many of a text and would vanish in a mean. As many rows are drawn
by Gumbel top-k as the threshold lets through. Rows near its end so come in or go by chance, as in any draw.

The target model, the evidence and the threshold are fitted on a bounded sample of labelled rows
(``sample_rows``), chosen by a hash of the id; the raw model counts all documents, and scores, decisions and the
sample cover all rows and whole texts. Null and empty texts have no n-grams and score 0. Labels that are null count as
not toxic, and as of good quality; of several labels of an id the worst counts. Without labels of both kinds nothing is rejected and all
score 0. Repeated rows each give a row with the same key; an empty table gives none. Columns may have clashing names.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import as_bytes, map_slices, map_whole, materialise, pick, slices
from tidemark.llm.simhash import shingle_hashes

#: Labelled rows that the models are fitted on, at most about; one in five is held out for the threshold.
SAMPLE_ROWS = 20_000
HELD_OUT = 5
#: An n-gram is evidence if at least so many rejected rows have it and its log ratio is at most this.
LEAST_ROWS, CLEAR = 5, -1.2
#: Share of the held-out target rows that the threshold may reject.
LOST = 0.003
#: Share of all rows that the sample has.
SHARE = 0.5
BINS = 4096

#: Buckets of the generative models.
BUCKETS = 1 << 16
#: Folds of the target, and what a mean log ratio is multiplied by.
FOLDS, TEMPERATURE = 5, 100.0
#: The same where evidence counts beside the mean.
DRAW_TEMPERATURE = 10.0
#: Of the Gumbel noise.
SEED = 11
#: Bytes whose characters are hashed at once; words are never cut.
CHUNK = 1 << 18

_SPACES = b" \t\n\r\x0b\x0c"
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SHAPE = np.array([97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256)], np.uint8)
_IS_SPACE = np.isin(np.arange(256), list(_SPACES))
_IS_EDGE = np.isin(np.arange(256), list(string.punctuation.encode()))
_BASE = 0x9E3779B97F4A7C15 | 1


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of one kind of n-gram, from numbers."""
    x = (x ^ np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of the base of a polynomial hash modulo 2^64, and of its inverse."""

    def __init__(self, count: int):
        self.up, self.down = (self._of(b, count) for b in (_BASE, pow(_BASE, -1, 1 << 64)))

    @staticmethod
    def _of(base: int, count: int) -> np.ndarray:
        out = np.full(count, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of pieces of ``raw``; equal pieces have equal ones."""
        if len(raw) > len(self.up):
            self.__init__(2 * len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[np.minimum(starts, len(raw) - 1)]


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _words(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the lower-cased words without punctuation at their edges; a word of punctuation only is empty."""
    starts, ends = _runs(~_IS_SPACE[raw])
    letters = np.flatnonzero(~_IS_EDGE[raw] & ~_IS_SPACE[raw])
    if len(letters):
        first = letters[np.minimum(np.searchsorted(letters, starts), len(letters) - 1)]
        last = letters[np.maximum(np.searchsorted(letters, ends) - 1, 0)] + 1
        empty = (first >= ends) | (last <= starts)
        first, last = np.where(empty, starts, first), np.where(empty, starts, last)
    else:
        first = last = starts
    return starts, powers.hashes(_LOWER[raw], first, last)


def _shapes(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words' shapes: classes of characters, runs of one class as one."""
    shape = _SHAPE[raw]
    kept = np.flatnonzero(np.concatenate(([True], shape[1:] != shape[:-1])) | _IS_SPACE[raw])
    short = shape[kept]
    starts, ends = _runs(~_IS_SPACE[short])
    return kept[starts], powers.hashes(short, starts, ends)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about CHUNK bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        yield text[at:end]
        at = end


class Grams:
    """N-grams of some texts: word, pair, shape and shape-pair hashes, each with the number of its text."""

    def __init__(self, texts: list[bytes], powers: Powers, shapes: bool = True):
        joined = b"\n".join(texts)
        opens = np.cumsum([0, *[len(t) + 1 for t in texts]])
        found: list[list] = [[], [], [], []]
        at = 0
        for piece in _pieces(joined):
            raw = np.frombuffer(piece, np.uint8)
            for k, of in ((0, _words), (2, _shapes))[: 2 if shapes else 1]:
                starts, hashes = of(raw, powers)
                found[k].append(starts + at)
                found[k + 1].append(hashes)
            at += len(piece)
        start, self.word, shape_start, shape = (np.concatenate([*f, np.zeros(0, np.uint64 if k % 2 else np.int64)]) for k, f in enumerate(found))
        self.texts = len(texts)
        self.word_text = np.searchsorted(opens, start, "right") - 1
        self.pair_text, self.pair = self._paired(self.word_text, self.word)
        self.shape_text, self.shape = np.searchsorted(opens, shape_start, "right") - 1, shape
        self.shape_pair_text, self.shape_pair = self._paired(self.shape_text, shape)

    @staticmethod
    def _paired(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = text[1:] == text[:-1]
        return text[1:][same], (hashes[:-1][same] * np.uint64(_BASE)) ^ (hashes[1:][same] >> np.uint64(1))

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and bucket of each word and pair, repeats included."""
        values = np.concatenate((_mixed(self.word, 1), _mixed(self.pair, 2)))
        return np.concatenate((self.word_text, self.pair_text)), (values >> np.uint64(48)).astype(np.int64)

    def evidence(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash (63 bits) of all n-grams that may speak against the target; not distinct."""
        again = (self.word[2:] == self.word[:-2]) & (self.word[1:-1] == self.word[:-2]) & (self.word_text[2:] == self.word_text[:-2]) if len(self.word) > 2 else np.zeros(0, bool)
        thrice = np.unique(self.word_text[2:][again]) if len(again) else np.zeros(0, np.int64)
        order = np.lexsort((self.word, self.word_text))
        text, word = self.word_text[order], self.word[order]
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (word[1:] != word[:-1]))) if len(text) else np.zeros(0, bool)
        words, distinct = np.bincount(text, minlength=self.texts), np.bincount(text[new], minlength=self.texts)
        many = np.flatnonzero(words >= 20)
        tenth = 10 * distinct[many] // words[many] + np.where(words[many] < 200, 0, 16)
        parts = [(self.word_text, self.word, 3), (self.pair_text, self.pair, 4), (self.shape_text, self.shape, 5), (self.shape_pair_text, self.shape_pair, 6), (thrice, np.zeros(len(thrice), np.uint64), 7), (many, tenth.astype(np.uint64), 8)]
        return np.concatenate([t for t, _, _ in parts]), np.concatenate([_mixed(h, k) for _, h, k in parts]) >> np.uint64(1)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """target (boolean), held (boolean) and text of a bounded sample of labelled rows."""
    marks = pick(labels, id_col, "quality", "toxic").where(F.col(id_col).isNotNull())
    marks = marks.groupBy(id_col).agg(F.min(F.coalesce("quality", F.lit(1)) * F.when(F.coalesce("toxic", F.lit(0)) == 0, 1).otherwise(0)).alias("good"))
    every = max(1, math.ceil(marks.count() / sample_rows))
    chosen = marks.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)
    held = F.pmod(F.xxhash64(id_col, F.lit("held")), F.lit(HELD_OUT)) == 0
    return as_bytes(docs, text_col, id_col).join(F.broadcast(chosen), id_col).select((F.col("good") == 1).alias("target"), held.alias("held"), F.col(text_col).alias("text"))


#: Signatures of a text by which near copies in the sample are found.
SIGNATURES = 3


def signatures(text: bytes) -> list[int]:
    """The least hashes of a text's five-word shingles under several mixings: near copies share most of them."""
    hashes = shingle_hashes(text, 5)
    return [int((hashes * np.uint64(2 * k + 3) ^ (hashes >> np.uint64(17 + k))).min() >> np.uint64(1)) if len(hashes) else 0 for k in range(SIGNATURES)]


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row of each group of near copies with one label, as an n-gram of a text that is copied a hundred times has
    been seen once."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [signatures(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([f[k] for f in found], pa.int64()) for k in range(SIGNATURES)]], names=["row", "target", *names])

    names = [f"sig{k}" for k in range(SIGNATURES)]
    left = materialise(map_slices(rows.select("row", "target", "text"), lambda: sign, "row long, target boolean, " + ", ".join(f"{n} long" for n in names)))
    for n in names:
        left = left.join(left.groupBy("target", n).agg(F.min("row").alias("row")).select("row"), "row", "left_semi")
    return rows.join(left.select("row"), "row", "left_semi")


def folds(texts: list[bytes], count: int = FOLDS) -> np.ndarray:
    """Fold of each text: copies are in one."""
    return np.array([xxhash.xxh64_intdigest(t, 5) % count for t in texts], np.int64)


def _bucket_counts(rows: DataFrame, count: int = 1) -> np.ndarray:
    """Words and pairs in each fold and bucket over all rows of a text column (bytes): sums a task, then over all tasks; as many numbers as buckets in all folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sums = Powers(CHUNK), np.zeros(count * BUCKETS, np.int64)
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            text, bucket = Grams(texts, powers, False).buckets()
            if count > 1:
                bucket = bucket + folds(texts, count)[text] * BUCKETS
            sums += np.bincount(bucket, minlength=count * BUCKETS)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["bucket", "n"])

    out = np.zeros(count * BUCKETS, np.int64)
    for r in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out.reshape(count, BUCKETS)


def _evidence_counts(fitted: DataFrame) -> DataFrame:
    """gram, target, other: how many target rows and other rows have each n-gram."""

    def make():
        powers = Powers(CHUNK)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            text, gram = Grams(batch.column(1).to_pylist(), powers).evidence()
            order = np.lexsort((text, gram))
            text, gram = text[order], gram[order]
            new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1]))) if len(gram) else np.zeros(0, bool)
            text, gram = text[new], gram[new]
            target = np.array(batch.column(0).to_pylist(), bool)[text]
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
            sums = [np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for x in (target, ~target)]
            return pa.RecordBatch.from_arrays([pa.array(gram[first].astype(np.int64)), *map(pa.array, sums)], names=["gram", "target", "other"])

        return apply

    counts = map_slices(fitted, make, "gram long, target long, other long")
    return counts.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("other").alias("other"))


class Model:
    """Log ratios of the buckets for the texts of each fold, the n-grams that speak against the target (sorted) with their weights, and the least evidence that is kept."""

    def __init__(self, ratios: np.ndarray, grams: np.ndarray, weights: np.ndarray, cut: float = -math.inf):
        self.ratios, self.grams, self.weights, self.cut = ratios, grams, weights, cut

    def score(self, texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """Log importance and evidence of each text."""
        grams = Grams(texts, powers, len(self.grams) > 0)
        text, bucket = grams.buckets()
        sums = np.bincount(text, self.ratios[folds(texts, len(self.ratios))[text], bucket], len(texts)).astype(float)
        importance = TEMPERATURE * sums / np.maximum(np.bincount(text, minlength=len(texts)), 1)
        if not len(self.grams):
            return importance, np.zeros(len(texts))
        text, gram = grams.evidence()
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        hit = self.grams[place] == gram
        pairs = np.unique(text[hit] * len(self.grams) + place[hit])
        return importance, np.bincount(pairs // len(self.grams), self.weights[pairs % len(self.grams)], len(texts)).astype(float)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the shares of each bucket, for each fold from the other folds of the target, which are smoothed towards the raw text."""
    share = (raw + 1.0) / (raw.sum() + len(raw))
    others = target.sum(0) - target
    return np.log((others + len(raw) * share) / (others.sum(1, keepdims=True) + len(raw)) / share)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The models. The driver gets the bucket counts and the n-grams that count: at most the sample's n-grams over LEAST_ROWS."""
    rows = materialise(labelled(docs, labels, id_col, text_col, sample_rows).withColumn("row", F.monotonically_increasing_id()))
    fitted = materialise(one_of_each(rows.where("NOT held")))
    sizes = {r.target: r["count"] for r in fitted.groupBy("target").count().collect()}
    n_target, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_target or not n_other:
        return Model(np.zeros((1, BUCKETS)), np.zeros(0, np.uint64), np.zeros(0))
    ratios = log_ratios(_bucket_counts(fitted.where("target").select("text"), FOLDS), _bucket_counts(as_bytes(docs, text_col))[0])
    ratio = F.log((F.col("target") + 0.5) / (n_target + 1)) - F.log((F.col("target") + F.col("other") + 0.5) / (n_target + n_other + 1))
    found = _evidence_counts(fitted.select("target", "text")).where(F.col("other") >= LEAST_ROWS).select("gram", ratio.alias("w")).where(F.col("w") <= CLEAR).orderBy("gram").collect()
    model = Model(ratios, np.array([r.gram for r in found], np.uint64), np.array([r.w for r in found], float))
    held = sorted(r.evidence for r in _scores(rows.where("held AND target").select(F.lit(0).alias("id"), "text"), model, "id").collect())
    # just below what the allowed share of held-out target rows has, and never so high that one weak n-gram is enough
    model.cut = min((held[int(LOST * len(held))] if held else 0.0) - 1e-9, CLEAR)
    return model


def _scores(rows: DataFrame, model: Model, id_col: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        powers = Powers(CHUNK)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            importance, evidence = shared.value.score(batch.column(1).to_pylist(), powers)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(importance), pa.array(evidence)], names=[id_col, "score", "evidence"])

        return apply

    return map_slices(rows, make, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, score double, evidence double")


def gumbel(id_col: str, seed: int) -> F.Column:
    """Standard Gumbel noise from a hash of the id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(-F.log(uniform))


def _kth_smallest(df: DataFrame, of: str, k: int) -> int:
    """The k-th smallest of a column of whole numbers, likewise."""
    while True:
        low, high = df.agg(F.min(of), F.max(of)).first()
        if low == high:
            return low
        bin_of = F.expr(f"(CAST({of} AS DECIMAL(20, 0)) - ({low})) DIV {(high - low) // BINS + 1}")
        for r in sorted(df.groupBy(bin_of.alias("bin")).count().collect(), key=lambda r: r["bin"]):
            if r["count"] >= k:
                df = df.where(bin_of == r["bin"])
                break
            k -= r["count"]


def kth_largest(df: DataFrame, key: str, tie: str, k: int) -> tuple[float, object] | None:
    """Key and tie of the k-th row by descending key, then ascending tie: by histograms that close in on it."""
    if k <= 0:
        return None
    now, left = df, k
    while True:
        low, high, n = now.agg(F.min(key), F.max(key), F.count("*")).first()
        if low == high and n > BINS:
            return low, _kth_smallest(now, tie, left)
        if n <= BINS:
            row = now.orderBy(F.desc(key), F.asc(tie)).limit(left).agg(F.min_by(F.struct(key, tie), F.struct(F.col(key), -F.col(tie)))).first()[0]
            return row[0], row[1]
        bin_of = F.least(F.floor((F.col(key) - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in sorted(now.groupBy(bin_of.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
            if r["count"] >= left:
                now = now.where(bin_of == r["bin"])
                break
            left -= r["count"]


def _largest(df: DataFrame, key: str, id_col: str, k: int) -> F.Column:
    """Whether a row is among the k largest by key; equal keys go by the smaller id, rows equal in both are all among them."""
    tie = F.coalesce(id_col, F.lit(-1))
    last = kth_largest(df.select(key, tie.alias("tie")), key, "tie", k)
    return (F.col(key) > last[0]) | ((F.col(key) == last[0]) & (tie <= last[1])) if last else F.lit(False)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """Row per document: id, score (log importance), evidence (against the target), keep (not rejected), gumbel_key, sampled (among the top share by key)."""
    model = fit(docs, labels, id_col, text_col, sample_rows)
    scored = _scores(as_bytes(docs, text_col, id_col), model, id_col)
    keyed = materialise(scored.select(id_col, "score", "evidence", (F.col("evidence") >= model.cut).alias("keep"), (F.col("score") + gumbel(id_col, seed)).alias("gumbel_key")))
    return keyed.withColumn("sampled", _largest(keyed, "gumbel_key", id_col, math.ceil(share * keyed.count())))


def drawn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, temperature: float = DRAW_TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The rows and columns of ``docs`` that importance resampling draws: Gumbel top-k by mean log ratio times ``temperature`` plus evidence, as many as
    have no more evidence against them than the threshold allows. The rows are stored once, with their keys, so that texts are scored once."""
    model = fit(docs, labels, id_col, text_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at, id_at, names = docs.columns.index(text_col), f"_c{docs.columns.index(id_col)}", [*plain.columns, "importance", "evidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(CHUNK)
        for batch in slices(batches):
            score, evidence = shared.value.score([(t or "").encode() for t in batch.column(at).to_pylist()], powers)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(temperature / TEMPERATURE * score + evidence), pa.array(evidence)], names=names)

    scored = plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("importance", DoubleType()), StructField("evidence", DoubleType())]))
    keyed = materialise(scored.select("*", (F.col("importance") + gumbel(id_at, seed)).alias("key")))
    size = keyed.where(F.col("evidence") >= model.cut).count()
    return keyed.where(_largest(keyed, "key", id_at, size)).select(*plain.columns).toDF(*docs.columns)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows and columns of ``docs`` without those that the evidence alone rejects."""
    model = fit(docs, labels, id_col, text_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(CHUNK)
        for batch in slices(batches):
            evidence = shared.value.score([(t or "").encode() for t in batch.column(at).to_pylist()], powers)[1]
            yield batch.filter(pa.array(evidence >= shared.value.cut))

    return map_whole(docs, run)
