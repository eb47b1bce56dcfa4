import hashlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute


def test_stages_and_run(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, tables).collect(), docs.schema)
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == docs.columns
    texts = seen["SimHash near-dedup"]
    sets = {d: brute.shingles(brute.low(t)) for d, t in texts.items()}
    assert all(brute.jaccard(sets[a], sets[b]) < 0.8 for a in sets for b in sets if a < b)
    for d, t in seen["benchmark decontamination"].items():
        n, hit, *_ = brute.benchmark_hits(texts[d], items)
        assert t == texts[d] if not hit else len(t) < len(texts[d])
    final = seen["secret scans"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, tables).collect()
    assert {r.doc_id for r in rows} == set(final)
    for r in rows:
        ids = t.encode(final[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert kept.where(F.col("n_chars") != F.length("text")).count() == 0
