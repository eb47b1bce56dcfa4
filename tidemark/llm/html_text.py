"""Main text of web pages by differencing each page with those of the nearest URLs on its host.

Pages are sorted by host, then URL path, and a page's neighbours are the two other URLs before and the
two after its own on its host. Of these the nearest is the one on either side with the longest common
path. The page's text lines (one a block element) are aligned with the nearest page's by longest common
subsequence; shared lines that the other neighbours have too are template and are deleted. Markup
decides only what has a name of its own: menus, footers, forms, scripts, adverts, notices, comments and
so on go at once, and the lines of an article or main element stay, since articles quote and copy each
other. All other lines are decided by the alignment; where a page has no neighbours it decides
nothing, and then only the article's lines stay if there is an article.

Null pages are empty, and an empty page has an empty text. Pages without a host have no neighbours.
Rows of one URL have the same neighbours, never each other, so that equal rows get equal texts; a URL
with several rows is represented by one of them, the least by id, then text. A table without rows gives none. Lines of
any length and pages of any size are taken whole; columns may have clashing names.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_slices, pick
from tidemark.llm.html_lines import page_lines
from tidemark.llm.sketches import range_of

#: Pages and characters in a range of URLs, about, and ranges at most: their bounds pass through the driver.
RANGE_PAGES, RANGE_CHARS, RANGES = 4_000, 8_000_000, 65_536
#: Neighbours on each side.
BESIDE = 2


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b."""
    n = min(len(a), len(b))
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least end in b of a common subsequence, by its length
    chains: list[tuple | None] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            elif j < ends[k]:
                ends[k], chains[k] = j, link
    found, link = [], chains[-1] if chains else None
    while link:
        found.append(link[0])
        link = link[1]
    return [*range(head), *reversed(found), *range(len(a) - tail, len(a))]


def template(hashes: list[int], others: list[list[int]]) -> set[int]:
    """Places of the lines that align with the first of some pages and that all the others have."""
    if not others:
        return set()
    shared = set(common_lines(hashes, others[0]))
    for other in others[1:]:
        known = set(other)
        shared = {i for i in shared if hashes[i] in known}
    return shared


def nearest_first(key: str, before: list[dict], after: list[dict]) -> list[list[int]]:
    """Lines of the neighbours, the one with the longest common path with the page first; both sides are nearest first."""

    def common(other: dict) -> int:
        n = 0
        for x, y in zip(key, other["key"]):
            if x != y:
                break
            n += 1
        return n

    sides = [before, after] if not after or (before and common(before[0]) >= common(after[0])) else [after, before]
    return [n["hashes"] for side in sides for n in side]


def kept_lines(inside: list[bool], hashes: list[int], others: list[list[int]]) -> list[bool]:
    gone = template(hashes, others)
    bare = not others and any(inside)
    return [own or (i not in gone and not bare) for i, own in enumerate(inside)]


def _ghosts(ends: dict[int, tuple[list[str], list[str]]]) -> list[tuple[str, int]]:
    """(key, range) of the keys that are sent to each range: its neighbours on both sides; ``ends`` has the three outer keys of each range."""
    keys, out, seen = sorted({k for low, high in ends.values() for k in (*low, *high)}), [], set()
    for to in sorted(ends):
        first, last = min(ends[to][0]), max(ends[to][1])
        at, end = bisect_left(keys, first), bisect_left(keys, last) + 1
        out += [(k, to) for k in (*keys[max(0, at - BESIDE) : at], *keys[end : end + BESIDE])]
        if first in seen:  # a URL in several ranges has one representative
            out.append((first, to))
        seen.update((first, last))
    return out


def _parsed(pages: DataFrame) -> DataFrame:
    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [page_lines(p or "") for p in batch.column(batch.schema.names.index("html")).to_pylist()]
        columns = {n: batch.column(n) for n in batch.schema.names if n != "html"}
        columns["lines"] = pa.array([f[0] for f in found], pa.list_(pa.string()))
        columns["inside"] = pa.array([f[1] for f in found], pa.list_(pa.bool_()))
        columns["hashes"] = pa.array([[xxhash.xxh64_intdigest(t) >> 1 for t in f[0]] for f in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict(columns)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    return map_slices(pages, lambda: apply, f"{kept}, lines array<string>, inside array<boolean>, hashes array<long>")


def _host_and_key(url: Column) -> tuple[Column, Column]:
    """Host, and a key in the order of host, path and URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return host, F.concat_ws("\u0001", host, path, url)


def _neighbours(df: DataFrame, descending: bool, name: str) -> DataFrame:
    """Adds an array of the up to two other keys before each row's own (after it if descending), nearest first."""
    order = Window.partitionBy("range").orderBy(F.desc("key") if descending else F.asc("key"), "tie", "tie2")
    past, up_to = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    near = F.struct("host", "key", "hashes")
    opens = ~F.lag("key").over(order).eqNullSafe(F.col("key"))
    found = df.withColumn("_opens", opens)
    found = found.withColumn("_own", F.when(F.col("_opens"), near))
    found = found.withColumn("_one", F.when(F.col("_opens"), F.last("_own", True).over(past)))
    found = found.withColumn("_both", F.when(F.col("_opens"), F.array("_one", F.last("_one", True).over(past))))
    sides = F.array_compact(F.last("_both", True).over(up_to))
    return found.withColumn(name, F.filter(sides, lambda n: n["host"] == F.col("host"))).drop("_opens", "_own", "_one", "_both")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_pages: int = RANGE_PAGES) -> DataFrame:
    """Row per page: id, url, text, n_chars, n_lines (outside of what goes at once), n_deleted (of these).

    The order is cut into ranges of about equal counts, a URL with very many rows into several. One row of each of the two URLs on
    either side of a range is also sent to it, so that each range is complete; rows without a host go to any range.
    """
    spark = pages.sparkSession
    host, key = _host_and_key(F.coalesce(url_col, F.lit("")))
    rows = pick(pages, id_col, url_col, html_col).select(id_col, F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"), key.alias("key"))
    rows = rows.withColumn("tie", F.lpad(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 20, "0")).withColumn("tie2", F.xxhash64("html"))
    total = rows.agg(F.count("*"), F.sum(F.length("html"))).first()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total[0] // range_pages), -(-(total[1] or 0) // RANGE_CHARS))
    parts = min(RANGES, wanted)
    place = F.concat_ws("\u0002", "key", "tie")
    hosted = rows.where("host != ''")
    cuts = hosted.select(place.alias("place")).repartitionByRange(parts, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("place"))
    bounds = sorted({r.place for r in cuts.collect()})[1:]  # fewer than parts
    anywhere = F.pmod(F.xxhash64("key", "tie"), F.lit(parts)).cast("int")
    own_range = range_of(place, bounds, "\uffff") if bounds else F.lit(0)
    ranged = rows.withColumn("range", F.when(F.col("host") == "", anywhere).otherwise(own_range)).withColumn("ghost", F.lit(False))
    keys = ranged.where("host != ''").select("range", "key").distinct()
    outer = {}
    for side, order in ((0, F.asc("key")), (1, F.desc("key"))):
        place = F.row_number().over(Window.partitionBy("range").orderBy(order))
        for r in keys.withColumn("_place", place).where("_place <= 3").groupBy("range").agg(F.sort_array(F.collect_list("key"), side == 0).alias("keys")).collect():  # three keys a range
            outer.setdefault(r["range"], ([], []))[side].extend(r["keys"])
    sent = spark.createDataFrame(_ghosts(outer), "edge string, to int")
    names = [id_col, "url", "html", "host", "key", "tie", "tie2"]
    ghosts = ranged.join(F.broadcast(sent), F.col("key") == F.col("edge")).groupBy("to", "edge").agg(F.min_by(F.struct(*names), F.struct("tie", "tie2")).alias("one"))
    ghosts = ghosts.select("one.*", F.col("to").alias("range"), F.lit(True).alias("ghost")).withColumn("tie", F.lit(""))
    parsed = _parsed(ranged).unionByName(_parsed(ghosts.select(*ranged.columns)).withColumn("lines", F.array().cast("array<string>")))
    beside = _neighbours(_neighbours(parsed.repartition(parts, "range"), False, "before"), True, "after").where("NOT ghost")
    side = F.array().cast("array<struct<host:string,key:string,hashes:array<bigint>>>")
    paired = beside.select(id_col, "url", "key", "lines", "inside", "hashes", *[F.when(F.col("host") != "", F.col(c)).otherwise(side).alias(c) for c in ("before", "after")])

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, deleted, count = [], [], []
        for key, lines, inside, hashes, before, after in zip(*[batch.column(i).to_pylist() for i in range(2, 8)]):
            keep = kept_lines(inside, hashes, nearest_first(key, before, after))
            texts.append(" ".join(t for t, k in zip(lines, keep) if k))
            count.append(len(lines))
            deleted.append(len(lines) - sum(keep))
        arrays = [pa.array(texts, pa.string()), *[pa.array(c, pa.int64()) for c in (map(len, texts), count, deleted)]]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=[id_col, url_col, "text", "n_chars", "n_lines", "n_deleted"])

    return map_slices(paired, lambda: apply, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {url_col} string, text string, n_chars long, n_lines long, n_deleted long")
