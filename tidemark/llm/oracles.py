"""SQL twins (DuckDB) of the operators that SQL can express, each by the plain definition instead of the operator's method."""

from __future__ import annotations

from tidemark.llm import sharding
from tidemark.llm.filter_audit import FILTERS
from tidemark.llm.spelling import COUNT, EVERY, FACTOR, LENGTH

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


def crc32(text: str) -> str:
    """The checksum of a text's UTF-8 bytes."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {octets}, lambda a, b: xor(a >> 8, {_crc_table()}[(xor(a, b) & 255) + 1])), 4294967295)"


_LETTERS = [f"(SELECT unnest(string_split('{FILTERS}', '')) AS {c}) AS t{c}" for c in FILTERS.lower()]

FILTER_AUDIT = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first OR (doc_id IS NULL AND first IS NOT NULL) THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
orders AS (
  SELECT {" || ".join(FILTERS.lower())} AS filter_order FROM {", ".join(_LETTERS)}
  WHERE len(list_distinct([{", ".join(FILTERS.lower())}])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter FROM orders, (SELECT unnest(range(1, 6)) AS step)),
gone AS (
  SELECT part, filter_order, fails, good, toxic, list_min(list_transform(string_split(fails, ''), lambda f: CASE WHEN f = '' THEN 9 ELSE instr(filter_order, f) END)) AS place, count(*) AS n
  FROM failed, orders GROUP BY ALL),
told AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN place > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN place = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, filter) AND place < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN place = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN place = step AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM gone JOIN steps USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM told"""


def _network(source: str) -> str:
    """One pass of the permutation over a table of i, n, h (bits of a half) and x."""

    def times(x: str, by: int) -> str:
        return f"CAST(CAST({x} AS UHUGEINT) * {by}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT)"

    last = int(sharding._MIX[1]), int(sharding._MIX[2])
    out = f"(SELECT i, n, h, x >> h AS l, x & ((1::UBIGINT << h) - 1) AS r FROM {source})"
    for key in sharding.Permutation(1).keys:
        added = f"(SELECT *, CAST((CAST(r AS UHUGEINT) + {int(key)}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS a FROM {out})"
        once = f"(SELECT * REPLACE ({times('xor(a, a >> 30)', last[0])} AS a) FROM {added})"
        twice = f"(SELECT * REPLACE ({times('xor(a, a >> 27)', last[1])} AS a) FROM {once})"
        out = f"(SELECT i, n, h, r AS l, xor(l, xor(a, a >> 31) & ((1::UBIGINT << h) - 1)) AS r FROM {twice})"
    return f"SELECT i, n, h, (l << h) | r AS x FROM {out}"


#: Ids are taken to be different, as in the given tables; the operator orders rows of one id by their content.
SHARDING = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS UBIGINT) AS i, CAST(count(*) OVER () AS UBIGINT) AS n FROM documents),
start AS (SELECT i, n, CAST(greatest(1, ceil(length(bin(greatest(n - 1, 1))) / 2)) AS UBIGINT) AS h, i AS x FROM d),
walk AS (
  {_network("start")}
  UNION ALL
  {_network("(SELECT * FROM walk WHERE x >= n)")})
SELECT doc_id, CAST(strlen(t) + 16 AS BIGINT) AS size, CAST({crc32("t")} AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(x % {sharding.SHARDS} AS INTEGER) AS shard, CAST(x // {sharding.SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(i AS BIGINT) AS row_number
FROM d JOIN (SELECT i, x FROM walk WHERE x < n) USING (i)"""

SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, {_LOWER.format("w")} AS w, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, k, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs),
vocabulary AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % {EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  GROUP BY word HAVING length(word) >= {LENGTH} AND sum(k) >= {COUNT}),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes AS a JOIN holes AS b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM holes AS a JOIN vocabulary AS b ON a.s = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM holes AS a JOIN vocabulary AS b ON a.s = b.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, list({{'n': other_n, 'w': other}} ORDER BY other_n DESC, other)[1] AS b FROM near GROUP BY word),
formed AS (SELECT word, n, n_near, CASE WHEN b.n >= {FACTOR} * n THEN b.w END AS form, CASE WHEN b.n >= {FACTOR} * n THEN b.n END AS form_n FROM best),
follow AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT follow.word, formed.form FROM follow JOIN formed ON formed.word = follow.root WHERE formed.form IS NOT NULL),
roots AS (SELECT follow.word, root FROM follow LEFT JOIN formed ON formed.word = root WHERE formed.form IS NULL)
SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form, CAST(form_n AS BIGINT) AS form_n, coalesce(root, v.word) AS root
FROM vocabulary AS v LEFT JOIN formed USING (word) LEFT JOIN roots USING (word)"""
