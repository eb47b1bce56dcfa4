import importlib
import math
import pathlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import scalars as S
from tidemark.operators import audits, axes, history, labels, lookups, metrics, model, sampling, split
from tidemark.plans import jobs, matrix, queries
from tidemark.sources import aggregates
from tidemark.sources import tables as T
from tidemark.streaming import history_state


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_scalars(spark):
    text = lambda x: F.lit(x).cast("string")
    assert [one(spark, S.parse_double(text(x))) for x in (" 1.5", "12abc", "inf", "", None, "-3e2")] == [1.5, 12.0, None, None, None, -300.0]
    assert [one(spark, S.mcc_key(text(x))) for x in (" 5411 ", "5411.0", "abc", "-2", None)] == [5411, 5411, -2, -2, -2]
    assert one(spark, S.clean_text(F.lit(" a\n\t"))) == "a\n" and one(spark, S.clean_text(F.lit(" \t"))) is None
    assert [one(spark, S.developer_flag(text(x))) for x in ("0.0", "2", "off", "Yes", " ")] == [0, 1, 0, 1, 0]
    assert [one(spark, S.remap_weight(F.lit(x))) for x in (1.0, 2.0, 5.0)] == [1, 5, 10]
    assert one(spark, S.parse_seconds(F.lit("1970-01-02 00:00:01.75"), "string")) == 86401 and one(spark, S.parse_seconds(F.lit("soon"), "string")) is None
    assert one(spark, S.logit(F.lit(1.0))) == pytest.approx(math.log((1 - 1e-15) / 1e-15), rel=1e-2)
    assert one(spark, S.clipped_position(F.lit(9.0), F.lit(1.0), F.lit(3.0))) == 1.0


def test_schema_checks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("c", 1, 2.0, "2024-01-01 00:00:00")], "customer_id string, event_id long, operaton_amt double, event_dttm string")
    assert T.schema_faults(df) == [] and T.schema_faults(df.drop("event_id")) == ["missing column event_id"]
    assert T.schema_faults(df.withColumn("battery", F.array(F.lit(1)))) == ["column battery has type array<int>, not amount"]
    df.write.parquet(f"{tmp_path}/a")
    got = T.read_transactions(spark, {"train": [f"{tmp_path}/a", f"{tmp_path}/none"], "test": [f"{tmp_path}/a"]})
    assert sorted(r.phase for r in got.collect()) == ["test", "train"]
    with pytest.raises(ValueError):
        T.read_transactions(spark, {"train": [f"{tmp_path}/none"]})
    assert [tuple(r) for r in T.write_predictions(df.select("event_id", F.lit(0.1).alias("predict")), f"{tmp_path}/p").collect()] == [(r.event_id, 0.1) for r in df.collect()]
    assert spark.read.option("header", True).csv(f"{tmp_path}/p").columns == ["event_id", "predict"]
    T.write_settings(spark, {"depth": 3}, f"{tmp_path}/s")
    assert T.read_settings(spark, f"{tmp_path}/s", {"depth": 1, "rate": 2}) == {"depth": 3, "rate": 2} and T.read_settings(spark, f"{tmp_path}/no", {"depth": 1}) == {"depth": 1}
    spark.createDataFrame([(1, 5.0)], "event_id long, sample_weight double").write.parquet(f"{tmp_path}/full_dataset_part_1.parquet")
    assert T.load_matrix(spark, str(tmp_path)).first().sample_weight == 10
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "event_id long, target int")
    marks.write.parquet(f"{tmp_path}/labels")
    assert [tuple(r) for r in T.read_labels(spark, f"{tmp_path}/labels").collect()] == [(1, 1)]
    assert sorted(r.event_id for r in T.read_label_ids(spark, f"{tmp_path}/labels").collect()) == [1, 2]
    again = spark.createDataFrame([(1, 1), (1, 0)], "event_id long, target int").coalesce(1)
    again.write.parquet(f"{tmp_path}/again")
    assert [tuple(r) for r in T.read_labels(spark, f"{tmp_path}/again").collect()] == [(1, 0)]  # the last one
    assert T.row_count(spark, [f"{tmp_path}/labels", f"{tmp_path}/again", f"{tmp_path}/no"]) == 6
    with pytest.raises(ValueError):
        T.feature_columns(again)
    T.head_slice(again, f"{tmp_path}/head", 1)
    T.write_jsonl(again, f"{tmp_path}/lines")
    T.write_axis(again, ["target"], f"{tmp_path}/axis")
    assert spark.read.parquet(f"{tmp_path}/head").count() == 1 and spark.read.json(f"{tmp_path}/lines").count() == 2 and [r.target for r in spark.read.parquet(f"{tmp_path}/axis").collect()] == [0, 1]


def test_types_of_input_columns(spark):
    row = spark.createDataFrame([("c", "12x", True, 3, "2024-01-01 00:00:00", 2.5)], "customer_id string, event_id string, battery boolean, operaton_amt tinyint, event_dttm string, event_type_nm float")
    got = T.conform(row).first()
    assert (got.event_id, got.battery, got.amt, got.et, got.event_dttm) == (12, None, None, 2.5, "2024-01-01 00:00:00")
    assert T.conform(row.withColumn("event_id", F.lit(None).cast("long"))).first().event_id is None


def test_large_customers_are_cut(spark, tables, monkeypatch):
    tx = queries.transactions(spark, tables).withColumn("customer_id", F.when(F.col("customer_id").cast("long") % 3 == 0, "hot").otherwise(F.col("customer_id")))
    names = ["log_1_plus_transactions_seen", "amount_zscore", "delta_1", "std_time_deltas", "mcc_same_count_suffix"]
    whole = {r.event_id: tuple(r) for r in history.history_features(tx, names, cap=20).collect()}
    monkeypatch.setattr(history, "RANGE_ROWS", 25)
    assert history._ranges(tx, 20).where("ghost").count() > 0
    cut = {r.event_id: tuple(r) for r in history.history_features(tx, names, cap=20).collect()}
    rounded = lambda rows: {i: [None if v is None else float(f"{v:.9g}") for v in r] for i, r in rows.items()}
    assert rounded(cut) == rounded(whole)  # sums are added in another order


def test_stored_aggregates(spark, tables, tmp_path):
    tx = queries.transactions(spark, tables)
    aggregates.write(tx, str(tmp_path))
    got, want = aggregates.read(spark, str(tmp_path)), aggregates.fitted(tx)
    key = ["axis", "k1", "k2"]
    read = {tuple(r[k] for k in key): (r["mean"], r["cnt"], r["log_frequency"]) for r in got.statistics.collect()}
    assert read == {tuple(r[k] for k in key): (r["mean"], r["cnt"], r["log_frequency"]) for r in want.statistics.collect()}
    assert sorted(map(str, got.top3.collect())) == sorted(map(str, want.top3.select(got.top3.columns).collect()))
    with pytest.raises(FileNotFoundError):
        aggregates.read(spark, f"{tmp_path}/none")
    spark.read.parquet(f"{tmp_path}/pos_cd.parquet").where("pos_cd <> '__GLOBAL__'").write.parquet(f"{tmp_path}/other")
    spark.read.parquet(f"{tmp_path}/other").write.mode("overwrite").parquet(f"{tmp_path}/pos_cd.parquet")
    with pytest.raises(ValueError, match="pos_cd"):
        aggregates.read(spark, str(tmp_path))


def test_jobs(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMARK_SCORES", f"{tmp_path}/elsewhere")
    paths = jobs.Paths(str(tmp_path))
    assert paths.matrix == f"{tmp_path}/matrix" and paths.scores == f"{tmp_path}/elsewhere"
    raw = queries.fixtures.raw_transactions(spark, tables).where("event_id % 3 = 0")
    files = {"pretrain": "pretrain_part_1", "train": "train_part_2", "test": "test"}
    for phase, name in files.items():
        raw.where(F.col("phase") == phase).drop("phase", "labelled", "label").write.parquet(f"{paths.data}/{name}.parquet")
    raw.where("labelled").selectExpr("event_id", "label AS target").write.parquet(paths.labels)
    tx = jobs.read_inputs(spark, paths)
    assert tx.where("labelled").count() == raw.where("labelled").count() and {r.phase for r in tx.select("phase").distinct().collect()} == set(files)
    monkeypatch.setattr(jobs.matrix.history, "FEATURES", {"operation_amt": "amt"})
    T.write_settings(spark, {"maxIter": 1, "maxDepth": 2}, paths.settings)
    out = jobs.run(spark, paths)
    assert out.count() == raw.where("phase = 'test'").count() == spark.read.option("header", True).csv(paths.scores).count()


def test_axis_edges(spark):
    rows = [("train", 1.0, False, 1), ("train", 3.0, False, 1), ("train", 9.0, True, 1), ("pretrain", None, False, 2), ("test", 5.0, False, 1)]
    tx = spark.createDataFrame(rows, "phase string, amt double, labelled boolean, mcc_key long")
    got = {r.k1: r for r in axes.axis_statistics(tx, {"mcc": (F.col("mcc_key").cast("string"), F.lit(""))}).collect()}
    assert (got["1"].mean, got["1"].cnt, got["1"].cnt_clean, got["1"].label_count) == (2.0, 3, 2, 1) and got["2"].label_rate is None and got["2"].mean is None
    assert got["__GLOBAL__"].cnt == 4 and got["__GLOBAL__"].woe == pytest.approx(0.0)
    rough = {r.k1: r for r in axes.axis_statistics(tx, {"mcc": (F.col("mcc_key").cast("string"), F.lit(""))}, approximate=True).collect()}
    assert rough["1"].q99 == 3.0


def test_unseen_key_takes_the_population_row(spark, tables):
    tx = queries.transactions(spark, tables)
    stats = axes.axis_statistics(tx, {"pos_cd": axes.axis_keys()["pos_cd"]})
    new = tx.limit(5).withColumn("pos", F.lit("never seen"))
    every = stats.where("k1 = '__GLOBAL__'").first()
    assert {r.global_mean_amount_pos_cd for r in lookups.with_axis(new, stats, "pos_cd").collect()} == {every["mean"]}


def test_feature_names(spark):
    names = [*history.FEATURES, *lookups.feature_names()]
    assert (len(history.FEATURES), len(lookups.feature_names()), len(set(names))) == (98, 146, 244)


def test_sampler_matches_plain_arithmetic():
    mask = (1 << 64) - 1

    def mix(z):
        z = (z + 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        return z ^ (z >> 31)

    def draw(event, customer):
        h = mix(event & mask)
        for c in customer.encode():
            h = mix(h ^ (c + 0x100000001B3))
        return (mix(h ^ 0xD6E8FEB866B13AD5) & ((1 << 53) - 1)) / ((1 << 53) - 1)

    events, customers = [0, 1, -5, 10**15], ["", "7", "abé", "customer"]
    assert sampling.draws(np.array(events), customers).tolist() == [draw(e, c) for e, c in zip(events, customers)]


def test_average_precision_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1, 1.0), (0.8, 0, 2.0), (0.8, 1, 1.0), (0.3, 0, 1.0), (0.1, 1, 3.0)], "score double, target int, w double")
    assert metrics.average_precision(df, weight="w").first().average_precision == pytest.approx(0.2 * 1 + 0.2 * 0.5 + 0.6 * 5 / 8)
    assert metrics.average_precision(df.limit(0)).first().average_precision is None


def test_split_edges(spark):
    df = spark.createDataFrame([(0,), (86400,), (86401,), (172800,), (None,)], "t long")
    got = {r.t: r.validation for r in split.with_split(df, share=0.3).collect()}
    assert got == {0: False, 86400: False, 86401: False, 172800: True, None: True}


def test_cohorts_and_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "customer_id string") for v in ("xyzz", "yw"))
    both = a.withColumn("of", F.lit("a")).unionByName(b.withColumn("of", F.lit("b")))
    found = labels.cohort_overlap(both, {n: F.col("of") == n for n in "ab"}, samples=15)
    assert (found.first().n_shared, found.first().sample_ids) == (1, ["y"])
    labels.check_disjoint(found, lambda left, right: True)
    with pytest.raises(ValueError, match="a and b share 1 customers, such as y"):
        labels.check_disjoint(found, lambda left, right: False)
    assert tuple(labels.id_sets(a, b).first()) == (1, 2, 1)


def test_model_end_to_end(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 3) if i % 5 else None, int(i % 7 > 4), 1.0, i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, target int, sample_weight double, validation boolean")
    fitted = model.train(df, ["a", "b"], maxIter=3)
    out = model.scored(fitted, df.where("validation"), ["a", "b"])
    assert metrics.average_precision(out, weight="sample_weight").first().average_precision > 0.95
    with pytest.raises(ValueError):
        model.scored(fitted, df, ["a"])
    importance = model.permutation_importance(fitted, df, ["a", "b"], repeats=2)
    ranked = importance.collect()
    assert ranked[0].feature == "a" and ranked[0].mean_drop > 0.1
    base = metrics.average_precision(model.scored(fitted, df, ["a", "b"]), weight="sample_weight").first().average_precision
    vector = model.assembled(df, ["a", "b"]).select("event_id", model.vector_to_array("features").alias("own"))
    drops = []
    for r in range(2):  # one feature and repeat at a time
        donor = model.permuted(vector, "own", 100 + 10 * r).select("event_id", F.col("own")[0].alias("a"))
        mixed = df.drop("a").join(donor, "event_id")
        drops.append(base - metrics.average_precision(model.scored(fitted, mixed, ["a", "b"]), weight="sample_weight").first().average_precision)
    assert ranked[0].mean_drop == pytest.approx(sum(drops) / 2)
    model.write_importance(importance, f"{tmp_path}/importance", top=1)
    assert "| 1 | a |" in "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/importance/report").collect())
    assert spark.read.option("header", True).csv(f"{tmp_path}/importance/ranking").count() == 2
    model.save(fitted, ["a", "b"], f"{tmp_path}/model")
    again, names = model.load(spark, f"{tmp_path}/model")
    assert names == ["a", "b"] and again.getNumTrees == fitted.getNumTrees
    mixed = model.permuted(df, "a", 5)
    assert sorted(r.a for r in mixed.collect()) == sorted(r.a for r in df.collect()) and mixed.count() == 400
    trials = model.grid_search(df, ["a", "b"], {"maxDepth": [1, 2], "maxIter": [2]})
    assert trials[0]["average_precision"] > 0.9 and model.write_trials(spark, trials, f"{tmp_path}/grid") == {"maxDepth": trials[0]["maxDepth"], "maxIter": 2}
    assert T.read_settings(spark, f"{tmp_path}/grid/best", {}) == {"maxDepth": trials[0]["maxDepth"], "maxIter": 2} and spark.read.json(f"{tmp_path}/grid/trials").count() == 2


def test_importance_pairs_split_bits_and_walks_trees_itself(spark, monkeypatch):
    r = np.random.default_rng(11)
    names = ["a", "b", "c", "d", "e", "flat"]
    odd = [None, float("nan"), float("inf"), -5.0, 0.0]
    data = []
    for i in range(900):
        x = [float(v) for v in r.normal(size=5)]
        target = int(x[0] + x[1] * x[2] + r.normal() * 0.3 > 0.4)
        x = [odd[r.integers(5)] if r.random() < 0.1 else v for v in x]
        data.append((i, i if i % 90 else None, *x, 1.0, target if i % 50 else None, float(r.choice([1.0, 2.0, 5.0])) if i % 70 else None, i % 4 == 0))
    df = spark.createDataFrame(data, "row long, event_id long, a double, b double, c double, d double, e double, flat double, target int, sample_weight double, validation boolean").repartition(3)
    known = df.where("event_id IS NOT NULL AND target IS NOT NULL AND sample_weight IS NOT NULL")
    fitted = model.train(known, names, maxIter=3, maxDepth=3)
    # a model's trees by hand give its own scores
    trees, splits = model.trees_of(fitted)
    assert fitted.getNumTrees > 1 and {names[i] for i, _ in splits} >= {"a", "b", "c"} and "flat" not in {names[i] for i, _ in splits}
    bits = model.ways(df, names, splits, ["row"]).collect()
    left = np.unpackbits(np.array([list(b.ways) for b in bits], np.uint8), axis=1, count=len(splits)).astype(bool)
    by_hand = {b.row: v for b, v in zip(bits, 1 / (1 + np.exp(-2 * sum(t.values(left) for t in trees))))}
    theirs = {row.row: row.score for row in model.scored(fitted, df, names).collect()}
    assert len(bits) == 900 and all(by_hand[k] == pytest.approx(v, abs=1e-12) for k, v in theirs.items())
    # one feature and repeat at a time, over rows that can be told apart
    precision = lambda rows: metrics.average_precision(model.scored(fitted, rows, names), weight="sample_weight").first().average_precision
    base, wanted = precision(known), {}
    for f in ("a", "flat"):
        drops = [base - precision(known.drop(f).join(model.permuted(known.select("event_id", f), f, 100 + 10 * k), "event_id")) for k in range(2)]
        wanted[f] = float(np.mean(drops)), float(np.std(drops, ddof=1))
    # no row passes through the model's own vectors, however many features are tried
    monkeypatch.setattr(type(fitted), "transform", lambda *_: pytest.fail("rows went through the model as vectors"))
    got = {row.feature: row for row in model.permutation_importance(fitted, known, names, repeats=2).collect()}
    assert sorted(got) == sorted(names)
    for f, (mean, deviation) in wanted.items():
        assert got[f].mean_drop == pytest.approx(mean, abs=1e-9) and got[f].std_drop == pytest.approx(deviation, abs=1e-9), f
    assert {row.feature for row in model.permutation_importance(fitted, known, names, tried=["flat", "a"], repeats=2).collect()} == {"flat", "a"}
    # every row, also one without an id or with that of another, has one donor and counts once
    twice = df.unionByName(df.where("event_id < 100"))
    rows = model.ways(twice, names, splits, ["event_id", "target", "sample_weight"])
    paired = model.donated(rows, 2)
    assert "SortMergeJoin" in paired._jdf.queryExecution().executedPlan().toString()  # donors are as many as rows: never broadcast
    pairs = paired.collect()
    for k in range(2):
        of = [p for p in pairs if p.repeat == k]
        assert sorted(bytes(p.own) for p in of) == sorted(bytes(p.donor) for p in of) == sorted(bytes(p.ways) for p in rows.collect())


def test_registered_importance_covers_all_features(spark, monkeypatch):
    from tidemark.plans import queries

    class Rows:
        def where(self, _):
            return self

    seen = {}
    monkeypatch.setattr(queries, "_model_rows", lambda *_: Rows())
    monkeypatch.setattr(queries.sampling, "within_budget", lambda rows, columns: seen.update(columns=columns) or rows)
    monkeypatch.setattr(queries.model, "train", lambda rows, features, **settings: seen.update(trained=features, settings=settings))
    monkeypatch.setattr(queries.model, "permutation_importance", lambda fitted, rows, features, tried=None, repeats=2: seen.update(tried=tried or features, repeats=repeats))
    queries.QUERIES["permutation_importance"](spark, "")
    assert len(seen["trained"]) == len(seen["tried"]) == 244 and seen["columns"] == 244 and seen["repeats"] == 5 and not seen["settings"]


def test_audits(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, float("inf"), None), (2, None, "bb")], "event_id long, x double, s string")
    got = {r.column_name: r for r in audits.column_profile(df).collect()}
    assert (got["s"].n_null, got["s"].largest, got["event_id"].n_distinct) == (1, 2.0, 2)
    assert tuple(audits.duplicate_ids(df).first()) == (3, 2, 1)
    assert audits.feature_health(df, ["x"]).first().n_infinite == 1
    assert audits.all_columns_there(df, ["event_id", "x"]) == ["unexpected s"] and audits.all_columns_there(df, df.columns) == []
    assert audits.profile(df, "schema").count() == 3 and audits.profile(df, "light").columns == ["column_name", "n", "n_null"]
    df.write.parquet(f"{tmp_path}/one.parquet")
    assert {r.name for r in audits.file_schemas(spark, f"{tmp_path}/one.parquet").collect()} == {"event_id", "x", "s"}
    assert audits.file_schemas(spark, str(tmp_path), recursive=True).count() >= 3


def test_footers_equal_a_scan(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "if(id % 7 = 0, null, cast(id AS double) / 3) AS x", "if(id % 5 = 0, null, concat('s', id)) AS s", "named_struct('a', id) AS nested", "if(id < 0, 1, null) AS none")
    df.repartition(3).write.option("parquet.block.size", 20_000).parquet(f"{tmp_path}/t")
    paths = [f.path for f in spark.read.format("binaryFile").load(f"{tmp_path}/t/*.parquet").select("path").collect()]
    got = {r.name: r for r in audits.footer_profile(spark, paths).collect()}
    want = {r.column_name: r for r in audits.column_profile(df.drop("nested")).collect()}
    assert {n: (got[n].n, got[n].n_null) for n in want} == {n: (r.n, r.n_null) for n, r in want.items()} and got["nested"].n == 5000
    assert {n: got[n].type for n in got} == {f.name: f.dataType.simpleString() for f in df.schema}
    found = audits.footers(spark, paths)
    assert found.rdd.getNumPartitions() == len(paths) == 3 and found.where("name = 'none'").first().least is None
    ends = found.where("name = 'id'").selectExpr("min(cast(least AS long)) AS a", "max(cast(largest AS long)) AS b").first()
    assert tuple(ends) == (0, 4999)


def test_row_samples_are_exact(spark):
    df = spark.range(3000).selectExpr("id % 1000 AS event_id", "id AS x").repartition(5)
    for rows in (0, 1, 2, 999, 1001, 2999, 3000, 5000):
        sample = sampling.row_sample(df, rows)
        assert sample.count() == sample.distinct().count() == min(rows, 3000)
    assert "Limit" not in sampling.row_sample(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert sampling.within_budget(df, 244).count() == 3000 and sampling.within_budget(df, 244, ram_gb=1e-9, least=70).count() == 70


def test_samples_of_overlaps_are_the_least(spark):
    rows = spark.range(100).selectExpr("lpad(id, 3, '0') AS customer_id", "explode(array('a', 'b', 'c')) AS of").where("of < 'c' OR customer_id % 2 = 0")
    found = {(r["left"], r["right"]): r for r in labels.cohort_overlap(rows.repartition(7), {n: F.col("of") == n for n in "abc"}, samples=15).collect()}
    assert found["a", "b"].sample_ids == [f"{i:03d}" for i in range(15)] and found["a", "c"].sample_ids == [f"{i:03d}" for i in range(0, 30, 2)] and found["b", "c"].n_shared == 50


def test_booleans_are_ones_and_zeros(spark):
    df = spark.createDataFrame([("c", 1, "1", "2024-01-01 00:00:00", True), ("c", 2, "1", "2024-01-01 00:00:00", False), ("c", 3, "1", "2024-01-01 00:00:00", None)], "customer_id string, event_id long, operaton_amt string, event_dttm string, compromised boolean")
    named = df.withColumnRenamed("compromised", "session_id")
    assert [r.sess for r in T.conform(named).orderBy("event_id").collect()] == ["1", "0", None]


def test_row_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "event_id")
    one, two = (sorted(r.event_id for r in sampling.row_sample(df, 50, seed).collect()) for seed in (1, 1))
    assert one == two and len(one) == 50 and one != sorted(r.event_id for r in sampling.row_sample(df, 50, 2).collect())
    assert sampling.affordable_rows(244) == 2_000_000 and sampling.affordable_rows(244, ram_gb=1) < 200_000 and sampling.affordable_rows(10**6) == 50_000


def test_matrix_columns(spark, tables):
    tx = queries.transactions(spark, tables)
    got = matrix.training_matrix(tx, sampling.length_distribution(tx.limit(0)))
    assert got.columns[244:] == [*T.META_COLUMNS, "t"] and T.feature_columns(got.drop("t")) == [*history.FEATURES, *lookups.feature_names()]
    # without a distribution every row sees one row of its past
    assert {round(r.log_1_plus_transactions_seen, 6) for r in got.select("log_1_plus_transactions_seen").collect()} <= {0.0, round(math.log(2), 6)}


def test_model_rows_compute_the_matrix_once(spark, monkeypatch):
    passed = spark.sparkContext.accumulator(0)
    tx = spark.createDataFrame([(i, 86_400 * (i % 10) if i % 13 else None, "train" if i % 5 else "test") for i in range(200)], "event_id long, t long, phase string")

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    plain = tx.where("phase = 'train'").drop("phase")
    monkeypatch.setattr(queries, "transactions", lambda *_: tx)
    monkeypatch.setattr(queries, "_matrix", lambda *_: plain.mapInArrow(counted, "event_id long, t long"))
    got = {r.event_id: r.validation for r in queries._model_rows(spark, "").collect()}
    assert passed.value == plain.count() == 160
    assert got == {r.event_id: r.validation for r in split.with_split(plain).collect()} and set(got.values()) == {True, False}


def test_population_joins_carry_narrow_rows(spark, tables):
    tx = queries.transactions(spark, tables)
    widths = []

    def walk(node):
        if node.nodeName() == "Join":
            widths.append(node.output().size())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(matrix.training_matrix(tx, sampling.length_distribution(tx.limit(0)))._jdf.queryExecution().optimizedPlan())
    assert len(widths) >= 12 and max(widths) < 100  # Spark compiles no stage of more fields as a whole


def test_stream_equals_batch(spark, tables, tmp_path):
    tx = queries.transactions(spark, tables).select("customer_id", "event_id", "t", "amt", "phase")
    for i, bound in enumerate([(0, 1_705_000_000), (1_705_000_000, 2_000_000_000)]):
        tx.where((F.col("t") >= bound[0]) & (F.col("t") < bound[1])).drop("phase").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(tx.drop("phase").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = history_state.running_history(stream, evict_after_ms=3_600_000).writeStream.format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    rows = tx.where("t < 2000000000").count()
    for _ in range(120):  # with a timeout batches go on without new rows, so the stream is never idle
        if spark.table("running").count() >= rows:
            break
        time.sleep(1)
    run.stop()
    values = lambda r: tuple(None if x is None else round(float(x) + 1e-7, 4) for x in r)
    got = {r.event_id: values(r[2:]) for r in spark.table("running").collect()}
    full = queries.transactions(spark, tables)
    past = history.with_past(full).selectExpr("event_id", "size(H) AS n", "aggregate(filter(H, x -> x.amt IS NOT NULL), 0D, (s, x) -> s + x.amt) / nullif(size(filter(H, x -> x.amt IS NOT NULL)), 0) AS mean")
    more = history.history_features(full, ["transactions_last_24h", "sum_amount_last_24h", "max_amount_last_24h", "time_since_prev_transaction"])
    want = {r.event_id: values((r.n, r.transactions_last_24h, r.sum_amount_last_24h, r.max_amount_last_24h, r["mean"], r.time_since_prev_transaction)) for r in past.join(more, "event_id").collect()}
    assert got == want


def test_entry_module(spark):
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and set(queries.QUERIES) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0


def test_optional_parts_stay_apart():
    root = pathlib.Path(importlib.import_module("tidemark").__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"tidemark\.llm|corpus_pipeline", path.read_text()), path


def test_summaries_of_parts_merge(spark, tables, tmp_path):
    tx = queries.transactions(spark, tables)
    parts = {"a": tx.where("event_id % 3 = 0"), "b": tx.where("event_id % 3 > 0")}
    for name, part in parts.items():
        aggregates.write_summary(part, f"{tmp_path}/{name}")
    aggregates.merge(spark, f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/ab")
    got = {(r.axis, r.k1, r.k2): r for r in aggregates.summary_statistics(spark, f"{tmp_path}/ab").collect()}
    want = {(r.axis, r.k1, r.k2): r for r in axes.axis_statistics(tx).collect()}
    assert set(got) == set(want)
    values = {}
    for r in axes.keyed(tx, axes.axis_keys()).where("amt IS NOT NULL AND NOT (phase = 'train' AND labelled)").collect():
        values.setdefault((r.axis, r.k1, r.k2), []).append(r.amt)
    for (axis, k1, k2), w in want.items():
        g = got[axis, k1, k2]
        for c in ("mean", "std", "cnt", "woe", "label_rate", "log_frequency", "cnt_clean"):
            assert g[c] == pytest.approx(w[c], rel=1e-9) if w[c] is not None else g[c] is None
        own = sorted(values[(axes.S.GLOBAL,) * 2 + ("",) if k1 == axes.S.GLOBAL else (axis, k1, k2)])
        for name, q in axes.QUANTILES.items():
            low, high = sum(v < g[name] for v in own) / len(own), sum(v <= g[name] for v in own) / len(own)
            assert low - 2.3 / axes.SKETCH - 1 / len(own) <= q <= high + 2.3 / axes.SKETCH + 1 / len(own)
