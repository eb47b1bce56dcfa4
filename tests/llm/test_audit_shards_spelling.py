"""The filter audit, the shards and the spelling variants against plain Python versions."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.brute import low
from tests.llm.test_edges import COLUMNS, LABELS, LONG, ROWS
from tidemark.llm import filter_audit, sharding, spelling

DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


# ---- filter audit


def test_ranks_are_lexicographic():
    assert [filter_audit.rank(o) for o in filter_audit.ORDERS] == list(range(120))


@pytest.mark.parametrize("mask", range(32))
def test_intervals_cover_each_order_once(mask):
    found = {}
    for step, start, end in filter_audit.intervals(mask):
        for r in range(start, end):
            assert r not in found
            found[r] = step
    want = {r: min((o.index(f) + 1 for i, f in enumerate("ABCDE") if mask >> i & 1)) for r, o in enumerate(filter_audit.ORDERS)} if mask else {}
    assert found == want


def plain_audit(rows, labels):
    by_id = {}
    for id_, quality, toxic in labels:
        if id_ is not None:
            good, bad = by_id.get(id_, (False, False))
            by_id[id_] = (good or quality == 1, bad or toxic == 1)
    key = lambda i: (i is None, i or 0)
    least = {}
    for id_, text, _ in rows:
        least[text or ""] = min(least.get(text or "", key(id_)), key(id_))
    masks = []
    for id_, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": key(id_) > least[t],
        }
        masks.append((source or "", {f for f, failed in fails.items() if failed}, by_id.get(id_, (False, False))))
    out, shapley = {}, Counter()
    for part in {m[0] for m in masks}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [m for m in masks if m[0] == part]
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                failing = [m for m in masks if m[0] == part and f in m[1]]
                left = [m for m in left if f not in m[1]]
                out[part, order, step] = (f, len(left), len(gone), len(failing) - len(gone), sum(m[1] == {f} for m in failing), sum(m[2][0] for m in gone), sum(m[2][1] for m in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], v[0]]) for k, v in out.items()}


def audited(docs, labels):
    fields = ("filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = filter_audit.audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[f] for f in fields) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_against_plain_version(spark):
    r = random.Random(1)
    long = [" ".join(f"w{r.randint(0, 400)}" for _ in range(260)) for _ in range(6)]
    few = [" ".join(f"w{r.randint(0, 30)}" for _ in range(230)) for _ in range(3)]
    pool = [*long, *few, *[t + " 100 %" for t in long[:3]], *[t.upper() for t in few + long[:2]], "short", "short & LOUD", "", None, "É " * 300, "a\x0bb\x1fc " * 150]
    rows = [(r.choice([None, *range(60)]), r.choice(pool), r.choice([None, "", "s", "s", "t"])) for _ in range(150)]
    rows += rows[:7]  # repeated rows
    labels = [(r.choice([None, *range(60)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(50)]
    got = audited(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == plain_audit(rows, labels)


def test_audit_of_odd_rows(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = [(r[0], r[1], r[3]) for r in ROWS]
    assert audited(odd, labels) == plain_audit(rows, LABELS)
    assert filter_audit.audit(odd.limit(0), labels).count() == 0
    assert {v[5:7] for v in audited(odd, labels.limit(0)).values()} == {(0, 0)}


# ---- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 1000, 4097])
def test_permutation(n):
    p = sharding.Permutation(n)
    out = p.forward(np.arange(n))
    assert sorted(out) == list(range(n)) and list(p.backward(out)) == list(range(n))
    if n > 100:
        assert sum(out == np.arange(n)) < 10 and list(out) != list(sharding.Permutation(n, seed=1).forward(np.arange(n)))
    assert sharding.row_at(*sharding.place(n // 2, n), n) == n // 2


def shards_of(docs):
    return sorted(tuple(r) for r in sharding.report(docs).collect())


def test_shards_do_not_depend_on_files_and_are_computable(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["", "a", "é", "x" * 5000]), None) for i in range(3, 1003)]
    r.shuffle(rows)
    first = shards_of(spark.createDataFrame(rows, DOCS).repartition(7))
    assert first == shards_of(spark.createDataFrame(sorted(rows), DOCS).coalesce(1))
    texts = {i: t.encode() for i, t, _ in rows}
    for id_, size, crc, law, shard, slot, grown, number in first:
        assert (size, crc, law, grown) == (len(texts[id_]) + 16, zlib.crc32(texts[id_]), "rows", None)
        assert number == id_ - 3 and (shard, slot) == sharding.place(number, 1000)
    for shard in range(40):
        assert sorted(row[5] for row in first if row[4] == shard) == list(range(25))


def test_shards_of_odd_rows(spark, odd):
    got = sharding.report(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS) and sorted(r.row_number for r in got) == list(range(len(ROWS)))
    assert max(r.size for r in got) == 1_000_016 and len({r.shard for r in got}) == len(ROWS)
    assert sharding.report(odd.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "x", None)] * 5000, DOCS).repartition(3)
    assert sorted(r.row_number for r in sharding.report(same).collect()) == list(range(5000))
    assert len(sharding.assigned(odd).columns) == len(odd.columns) + 3


def test_written_shards(spark, tmp_path):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=6, parts=2)
    got = spark.read.parquet(str(tmp_path / "shards"))
    assert {(r.doc_id, r.shard, r.slot) for r in got.collect()} == {(i, *sharding.place(i, 500, 6)) for i in range(500)}
    with pytest.raises(ValueError, match="clash"):
        sharding.write_shards(docs.withColumn("SHARD", docs.doc_id), str(tmp_path / "other"))


# ---- spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("block", [2, 7, 5000])
def test_near_pairs_against_all_pairs(spark, block):
    r = random.Random(block)
    words = {"".join(r.choice("abé") for _ in range(r.choice([1, 2, 5, 6, 6, 7, 7, 8]))) for _ in range(260)}
    words |= {"a" * n for n in range(6, 30)} | {"abcdefgh", "abcdefghi", "abcdefgi", "bcdefgh", "xbcdefgh", "abdefgh"}
    counts = {w: r.randint(1, 99) for w in words}
    got = [tuple(x) for x in spelling.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n long"), block).collect()]
    want = {(a, counts[a], b, counts[b]) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def plain_variants(rows, every):
    n = Counter()
    for id_, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def found_variants(docs, **settings):
    rows = spelling.variants(docs, **settings).collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


def test_variants_against_plain_version(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdeéÿ") for _ in range(r.randint(4, 9))) for _ in range(25)]
    weights = [1 / (i + 1) ** 1.5 for i in range(len(base))]
    typed = lambda w: w if r.random() < 0.9 else w[: (i := r.randrange(len(w)))] + r.choice("abc") + w[i + 1 :]
    rows = [(r.choice([None, i]), r.choice([" ", "-", "×", "1"]).join(typed(w).title() for w in r.choices(base, weights, k=400)), None) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = found_variants(docs, every=11, block=8)
    assert got == plain_variants(rows, 11) and any(v[2] for v in got.values())
    assert found_variants(docs) == plain_variants(rows, spelling.EVERY)


def test_ties_and_chains(spark):
    text = " ".join(["abcdefg"] * 5 + ["abcdefgh"] * 25 + ["abcdefghi"] * 125 + ["zabcdefg"] * 25)
    got = found_variants(spark.createDataFrame([(1, text, None)], DOCS), every=10**12)
    assert got["abcdefg"] == (5, 2, "abcdefgh", 25, "abcdefghi") and got["zabcdefg"][1:3] == (1, None) and got["abcdefghi"][4] == "abcdefghi"
    with pytest.raises(ValueError, match="common"):
        spelling.variants(spark.createDataFrame([(1, text, None)], DOCS), factor=1)


def test_spelling_of_odd_rows(spark, odd):
    assert found_variants(odd) == plain_variants(ROWS, spelling.EVERY) and len(LONG) > 100_000
    assert spelling.variants(odd.limit(0)).count() == 0
    long = spark.createDataFrame([(i, "w" * 20_000 + " " + "w" * 20_001, None) for i in range(5)], DOCS)
    assert set(found_variants(long, every=10**12).values()) == {(5, 1, None, None, "w" * 20_000), (5, 1, None, None, "w" * 20_001)}
