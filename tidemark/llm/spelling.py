"""Spelling variants: words one inserted, deleted or replaced code point apart, and the common form of each.

Search by sorted-list dynamic programming. The words of a block are scanned in sorted order with a
banded edit matrix (three cells a row, as one edit moves at most one place off the diagonal). A word keeps
the rows of the code points that it shares with the word before it (their longest common prefix) and adds rows
only for the rest. Where a row exceeds one edit in all its cells, all following words with that prefix are skipped.

Blocks: a pair of words, the shorter one of m code points, has its one edit at a place below m. Words are dealt
by (m, range of places, what they have before and after the range); first into the two halves of 0 to m,
and while a block has more than ``BLOCK`` words, into the halves of its range again, down to single places, where at most
one or two code points are free. So every pair meets in a block, no block grows with the vocabulary, and
of the blocks that a pair shares only the one that holds the end of its common prefix reports it.

Null texts have no words; a null id is written as an empty string in the hash that picks deletions. Texts and
words of any length are taken whole. Repeated rows count each time; ties of forms go to the smallest word; an empty
table has no words. Columns other than the two named are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, slices
from tidemark.sources.scratch import stored

LENGTH, COUNT, FACTOR, EVERY = 6, 5, 5, 199
#: Words in a block at most, unless its range is a single place.
BLOCK = 5_000
#: Different words that a task counts before it passes them on.
HELD = 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LAST = "\U0010ffff"
_PAIR = "word string, n long, near string, near_n long"


def word_counts(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word, n: the runs of letters of all texts, lower-cased (A to Z only), each with one code point deleted where
    ``every`` divides the hash of its document and itself. Counted in tasks first, then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))
            counts.clear()
            return out

        for batch in slices(batches):
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(b":" if id_ is None else b"%d:" % id_)
                own = Counter(_RUN.findall(text.as_buffer().to_pybytes().lower().decode()))  # bytes: only A to Z have a lower case
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    counts[word] += n
                if len(counts) >= HELD:
                    yield table()
        yield table()

    rows = as_bytes(docs, "text", "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, length: int = LENGTH, count: int = COUNT, every: int = EVERY) -> DataFrame:
    return word_counts(docs, every).where((F.length("word") >= length) & (F.col("n") >= count))


def _dealt(words: DataFrame, halves: Column) -> DataFrame:
    """Rows of words with m, lo, hi, each in the given ranges of places, by the key of the block."""
    out = words.withColumn("_half", F.explode(halves)).select("word", "n", "m", "_half.lo", "_half.hi")
    before = F.substring("word", F.lit(1), F.col("lo"))
    after = F.substring("word", F.length("word") - (F.col("m") - F.col("hi")) + 1, F.col("m") - F.col("hi"))
    return out.withColumns({"before": before, "after": after})


_BLOCK = ["m", "lo", "hi", "before", "after"]


def _halves() -> Column:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    return F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """The words (word, n) in all their blocks; those of a single word are left out, larger ones than ``block`` divided."""
    lengths = F.array(F.length("word"), F.length("word") - 1)
    todo = _dealt(words.withColumn("m", F.explode(lengths)).withColumns({"lo": F.lit(0), "hi": F.col("m")}), _halves())
    done = None
    while True:
        sizes = todo.groupBy(*_BLOCK).agg(F.count("*").alias("_size")).where("_size > 1")
        sized = stored(todo.join(sizes, _BLOCK))
        large = (F.col("_size") > block) & (F.col("hi") - F.col("lo") > 1)
        fit = sized.where(~large).drop("_size")
        done = fit if done is None else done.unionByName(fit)
        rest = sized.where(large).drop("_size")
        if rest.isEmpty():
            return done
        todo = _dealt(rest.drop("before", "after"), _halves())


def near_in_block(m: int, lo: int, hi: int, words: list[str], counts: list[int]) -> Iterator[tuple[str, int, str, int]]:
    """Both directions of each pair of a block at distance one whose common prefix ends in the block's range."""
    cut = m - hi
    items = sorted((w[lo : len(w) - cut], w, n) for w, n in zip(words, counts))
    parts = [p for p, _, _ in items]
    shared = [0] * len(parts)  # with the part before
    for i in range(1, len(parts)):
        a, b = parts[i - 1], parts[i]
        k, top = 0, min(len(a), len(b))
        while k < top and a[k] == b[k]:
            k += 1
        shared[i] = k
    width = hi - lo
    for q, own, own_n in items:
        if len(q) != width:
            continue  # the longer word of a pair is found from the shorter one
        # rows[d]: least edits from the first d code points of the scanned part to the first d - 1, d and d + 1 of q
        rows = [(9, 0, 1)]
        i = 0
        depth = 0
        while i < len(parts):
            part = parts[i]
            skipped = False
            while depth < len(part):
                c, (left, middle, right), d = part[depth], rows[depth], depth + 1
                # q's code points d - 1, d and d + 1, counted from 1
                a = min(left + (d < 2 or q[d - 2] != c), middle + 1) if d - 1 <= width else 9
                b = min(middle + (q[d - 1] != c), a + 1, right + 1) if d <= width else 9
                e = min(right + (q[d] != c), b + 1) if d + 1 <= width else 9
                del rows[d:]
                rows.append((a, b, e))
                depth = d
                if a > 1 and b > 1 and e > 1:
                    i, skipped, depth = bisect_left(parts, part[:d] + _LAST, i + 1), True, 0
                    while i < len(parts) and parts[i][depth : depth + 1] == part[depth]:
                        depth += 1
                    break
            if skipped:
                continue
            k = len(part) - width  # 0 or 1
            if (k == 0 and own < items[i][1] and rows[depth][1] == 1) or (k == 1 and rows[depth][0] == 1):
                common = 0
                while common < width and q[common] == part[common]:
                    common += 1
                if lo <= min(lo + common, m - 1) < hi:
                    other, n = items[i][1], items[i][2]
                    yield own, own_n, other, n
                    yield other, n, own, own_n
            i += 1
            depth = shared[i] if i < len(parts) else 0


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, near, near_n: all pairs of words (word, n) at distance one, in both directions, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, counts, out = None, [], [], []

        def table() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], ["word", "n", "near", "near_n"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *at, word, n in zip(*columns):
                if at != key:
                    if key is not None:
                        out.extend(near_in_block(*key[:3], held, counts))
                    key, held, counts = at, [], []
                held.append(word)
                counts.append(n)
                if len(out) >= 10_000:
                    yield table()
        if key is not None:
            out.extend(near_in_block(*key[:3], held, counts))
        yield table()

    dealt = blocks(words, block).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    return dealt.select(*_BLOCK, "word", "n").mapInArrow(run, _PAIR)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of all words with a form, by doubling the steps: counts grow by a factor with each step, so few rounds suffice."""
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(reached.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        reached = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return reached


def variants(docs: DataFrame, length: int = LENGTH, count: int = COUNT, factor: int = FACTOR, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """word, n, n_near (words near it), form (the commonest near word, if ``factor`` times as common), form_n, root (end of the forms)."""
    if factor <= 1:
        raise ValueError("forms must be more common than their variants, or they could follow each other in a circle")
    words = stored(vocabulary(docs, length, count, every))
    pairs = near_pairs(words, block)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))  # strings compare by their bytes, as code points do
    found = stored(pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")).select(
        "word", "n_near", *[F.when(-F.col("best.n") >= factor * F.col("n"), c).alias(name) for name, c in (("form", F.col("best.word")), ("form_n", -F.col("best.n")))]
    ))
    out = words.join(found, "word", "left").join(_roots(found.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
