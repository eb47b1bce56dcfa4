import random
import struct

import numpy as np
import xxhash

import corpus_pipeline
from tidemark.llm import quality

SCHEMA = "doc_id long, text string, lang string"


def made(spark, tmp_path, count=600):
    """Documents of which some hold a telling word, and others, without labels, only words that no good one has."""
    r = random.Random(2)
    common, poor = ([f"{k}{i}" for i in range(120)] for k in ("c", "p"))
    rows, marks = [], []
    for i in range(count):
        bad = i % 5 == 0
        text = [r.choice(poor if i % 10 == 0 else common) for _ in range(r.randint(150, 300))]
        if bad and i % 10:
            text[4] = text[9] = "idiotic"
        rows.append((i, " ".join(text), "en"))
        if i % 2 or i % 4 == 0 and i % 10:
            marks.append((i, 1, int(bad)))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.read.parquet(f"{tmp_path}/labels.parquet")


def noise(i):
    h = xxhash.xxh64_intdigest(struct.pack("<i", 11), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
    return float(-np.log(-np.log(((h >> 11) + 0.5) / 2**53)))


def test_pipeline_draws_by_importance_and_gumbel_noise(spark, tmp_path):
    docs, labels = made(spark, tmp_path)
    rows = quality.resample(docs, labels).collect()
    key = {g.doc_id: 0.1 * g.score + g.evidence + noise(g.doc_id) for g in rows}
    size = sum(g.keep for g in rows)
    want = set(sorted(key, key=lambda i: (-key[i], i))[:size])
    got = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).collect()}
    assert got == want and want != {g.doc_id for g in rows if g.keep} and 400 < size < 600
    good = {i for i in range(600) if i % 5}
    poor = {i for i in range(0, 600, 10)}
    assert len(got & good) > 0.97 * len(good) and len(got & poor) < len({g.doc_id for g in rows if g.keep} & poor)


def test_draw_of_odd_rows(spark, tmp_path):
    docs, labels = made(spark, tmp_path, 300)
    odd = spark.createDataFrame([(None, None, "a"), (None, "", "b"), (7, "c1 c2", "c"), (7, "c1 c2", "d"), (9001, "c3 f4 " * 200_000, None)], SCHEMA)
    clashing = docs.union(odd).selectExpr("*", "lang AS l", "text AS t").toDF("doc_id", "text", "lang", "TEXT", "text")
    got = quality.drawn(clashing, labels)
    assert got.columns == clashing.columns and got.toDF("a", "b", "c", "d", "e").where("b <=> e").count() == got.count() > 200
    found = [r[2] for r in got.collect()]
    assert (("a" in found) == ("b" in found)) and (("c" in found) == ("d" in found))  # equal rows share their fate
    assert quality.drawn(docs.limit(0), labels).count() == 0
    assert sorted(map(str, quality.drawn(odd, labels.limit(0)).collect())) == sorted(map(str, odd.collect()))


def test_many_tied_keys_go_by_the_smaller_id(spark):
    ids = [-(2**63), *range(-4000, 4000), 2**63 - 1, 5, 5]
    df = spark.createDataFrame([(1.5, i) for i in ids] + [(2.0, 1), (0.5, 2)], "key double, tie long")
    ranked = sorted(ids)
    for k in (2, 3, 4001, len(ids), len(ids) + 1):
        assert quality.kth_largest(df, "key", "tie", k) == (1.5, ranked[k - 2])
    assert quality.kth_largest(df, "key", "tie", 1) == (2.0, 1) and quality.kth_largest(df, "key", "tie", len(ids) + 2) == (0.5, 2)
