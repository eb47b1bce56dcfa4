"""Boosted trees: training with a time split, scoring, grid search, permutation importance."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.metrics import average_precision, average_precisions_of_sums
from tidemark.sources.binned import matrix_of
from tidemark.sources.scratch import stored
from tidemark.sources.tables import read_settings, write_settings

#: Stands for a missing value: below every feature, so that a split can send it to either side together with the lowest values
#: or, with a split below those, on its own.
ABSENT = -1e12
DEFAULTS = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 1.0}


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``features``, a vector with missing values and infinities replaced."""
    plain = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), ABSENT).otherwise(F.col(c).cast("double")).alias(c) for c in features]
    rest = [c for c in df.columns if c not in features]
    wide = df.select(*rest, *[F.col(c).alias(f"_keep_{c}") for c in features], *plain)
    out = VectorAssembler(inputCols=features, outputCol="features").transform(wide).drop(*features)
    return out.withColumnsRenamed({f"_keep_{c}": c for c in features})


def train(df: DataFrame, features: list[str], target: str = "target", weight: str = "sample_weight", validation: str = "validation", **settings) -> GBTClassificationModel:
    """Fits on rows without ``validation``, which stop the boosting early."""
    rows = assembled(df.select(*features, F.col(target).cast("double").alias(target), weight, validation), features)
    gbt = GBTClassifier(featuresCol="features", labelCol=target, weightCol=weight, validationIndicatorCol=validation, seed=7, **(DEFAULTS | settings))
    return gbt.fit(rows)


def scored(model: GBTClassificationModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``score`` (probability) and ``predict`` (its logit)."""
    if model.numFeatures != len(features):
        raise ValueError(f"the model has {model.numFeatures} features, not {len(features)}")
    out = model.transform(assembled(df, features)).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("predict", S.logit(F.col("score"))).drop("features", "rawPrediction", "probability", "prediction")


def grid(options: dict[str, list]) -> list[dict]:
    return [dict(zip(options, values)) for values in itertools.product(*options.values())]


def grid_search(df: DataFrame, features: list[str], options: dict[str, list]) -> list[dict]:
    """Settings and average precision on validation rows of each trial, the best first."""
    trials = []
    for settings in grid(options):
        out = scored(train(df, features, **settings), df.where("validation"), features)
        trials.append(settings | {"average_precision": average_precision(out, weight="sample_weight").first()[0]})
    return sorted(trials, key=lambda t: -(t["average_precision"] or 0.0))


def permuted(df: DataFrame, column: str, seed: int) -> DataFrame:
    """The column's values moved among the rows: each row takes that of the row its rank in a hash order falls on.

    Rows and values are ranked in the same way, by range-partitioned order and position, so no task holds all.
    """
    own = df.withColumn("_at", F.xxhash64("event_id", F.lit(seed)))
    given = df.select(F.col(column).alias("_value"), F.xxhash64("event_id", F.lit(seed + 1)).alias("_at"))
    return ranked(own, "_at").drop(column).join(ranked(given, "_at").drop("_at"), "_rank").withColumnRenamed("_value", column).drop("_rank", "_at")


def ranked(df: DataFrame, by: str, within: list[str] | None = None) -> DataFrame:
    """Adds _rank, the row's place in the order (of its group, by the columns ``within``): its place in its range plus the sizes of the ranges before."""
    from pyspark.sql import Window

    groups = within or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = 2**64 / parts  # the order is that of a hash, so equal ranges are about equally full
    ranged = df.withColumn("_range", F.floor((F.col(by).cast("double") + 2.0**63) / step))
    sizes = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*groups, "_range", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("_base"))  # a row a range
    place = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(by))
    return ranged.join(F.broadcast(before), [*groups, "_range"]).withColumn("_rank", F.col("_base") + place).drop("_range", "_base")


@dataclass
class Tree:
    """A fitted tree over the splits of its model: a node's split (0 at a leaf), the nodes that its rows go to (a leaf's are itself), and leaves' values times the tree's weight."""

    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def values(self, left: np.ndarray) -> np.ndarray:
        """The value of the leaf that each row ends in; ``left`` has whether a row goes left, by row and split."""
        at, rows = np.zeros(len(left), np.int64), np.arange(len(left))
        for _ in range(self.depth):
            at = np.where(left[rows, self.split[at]], self.left[at], self.right[at])
        return self.value[at]


def trees_of(model: GBTClassificationModel) -> tuple[list[Tree], list[tuple[int, float]]]:
    """The trees, and feature and threshold of every split: a row goes left if its value is at most the threshold."""
    lines = [line.strip() for line in model.toDebugString.splitlines()]
    starts = [i for i, line in enumerate(lines) if re.match(r"Tree \d+ \(weight", line)]
    splits: list[tuple[int, float]] = []
    trees = []
    for start, weight in zip(starts, model.treeWeights):
        nodes: list[list] = []
        rest = iter(lines[start + 1 :])

        def grow() -> tuple[int, int]:
            """The node that the next lines describe, and the depth below it."""
            k, line = len(nodes), next(rest)
            nodes.append([0, k, k, 0.0])
            if leaf := re.match(r"Predict: (\S+)", line):
                nodes[k][3] = float(leaf[1]) * weight
                return k, 0
            if not (test := re.match(r"If \(feature (\d+) <= (\S+)\)", line)):
                raise ValueError(f"not a split of numbers: {line}")
            nodes[k][0] = len(splits)
            splits.append((int(test[1]), float(test[2])))
            nodes[k][1], a = grow()
            next(rest)  # Else
            nodes[k][2], b = grow()
            return k, 1 + max(a, b)

        _, depth = grow()
        trees.append(Tree(*[np.array(c) for c in zip(*nodes)], depth))
    return trees, splits


def ways(df: DataFrame, features: list[str], splits: list[tuple[int, float]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``ways``, a bit a split: whether the row goes left there. Only the columns that are split on are read; values as in ``assembled``."""
    used = sorted({i for i, _ in splits})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = np.empty((batch.num_rows, len(splits)), bool)
            for k, i in enumerate(used):
                values = batch.column(len(keep) + k).fill_null(float("nan")).to_numpy(zero_copy_only=False)
                values = np.where(np.isfinite(values), values, ABSENT)
                for j in (j for j, (of, _) in enumerate(splits) if of == i):
                    left[:, j] = values <= splits[j][1]
            packed = pa.array([r.tobytes() for r in np.packbits(left, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], packed], names=[*keep, "ways"])

    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "ways binary"])
    return df.select(*keep, *[F.col(features[i]).cast("double").alias(f"_f{i}") for i in used]).mapInArrow(run, kinds)


def donated(rows: DataFrame, repeats: int) -> DataFrame:
    """repeat, target, sample_weight, own and donor: in each repeat every row's ways, and those of the row that ``permuted`` gives it."""
    at = lambda seed: F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.xxhash64("event_id", F.lit(seed + 10 * r)).alias("_at")) for r in range(repeats)])).alias("e")
    own = rows.select(at(100), "target", "sample_weight", F.col("ways").alias("own")).select("e.*", "target", "sample_weight", "own")
    given = rows.select(at(101), F.col("ways").alias("donor")).select("e.*", "donor")
    # a few bytes a row in files, but a row for each repeat: by its own estimate Spark would broadcast it
    return ranked(own, "_at", ["repeat"]).drop("_at").join(ranked(given, "_at", ["repeat"]).drop("_at").hint("merge"), ["repeat", "_rank"]).drop("_rank")


def permuted_sums(pairs: DataFrame, trees: list[Tree], splits: list[tuple[int, float]], places: list[int], repeats: int) -> DataFrame:
    """place, repeat, score and the weights of its positive rows (p) and of all its rows (a), where a row's feature at that place comes from its donor.

    Only the trees that split on the feature are walked again, and only by rows that then go another way. Sums are by batch, so a score can
    have several. Place and repeat are -1 for the rows as they are.
    """
    columns = {i: [j for j, (of, _) in enumerate(splits) if of == i] for i in [-1, *places]}  # none is of place -1
    walked = {i: [k for k, t in enumerate(trees) if t.depth and {*t.split[t.left != np.arange(len(t.left))].tolist()} & {*c}] for i, c in columns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, donor = (np.unpackbits(matrix_of(batch, (len(splits) + 7) // 8, c), axis=1, count=len(splits)).astype(bool) for c in ("own", "donor"))
            repeat = batch.column("repeat").to_numpy()
            weight = batch.column("sample_weight").fill_null(0.0).to_numpy(zero_copy_only=False)
            positive = np.where(batch.column("target").fill_null(0.0).to_numpy(zero_copy_only=False) == 1, weight, 0.0)
            base = [t.values(own) for t in trees]
            for i, at in columns.items():
                parts, of = list(base), repeat
                rows = np.flatnonzero((own[:, at] != donor[:, at]).any(1))
                mixed = own[rows]
                mixed[:, at] = donor[np.ix_(rows, at)]
                for k in walked[i]:
                    parts[k] = parts[k].copy()
                    parts[k][rows] = trees[k].values(mixed)
                score = 1 / (1 + np.exp(-2 * sum(parts)))
                taken = slice(None)
                if i < 0:  # each row once
                    taken, of = repeat == 0, np.zeros_like(repeat)
                scores, inverse = np.unique(score[taken], return_inverse=True)
                if not len(scores):
                    continue
                cell = inverse * repeats + of[taken]
                sums = [np.bincount(cell, w, len(scores) * repeats) for w in (positive[taken], weight[taken])]
                full = np.flatnonzero(np.bincount(cell, minlength=len(scores) * repeats))
                found = [np.full(len(full), i, np.int32), np.full(len(full), -1, np.int32) if i < 0 else (full % repeats).astype(np.int32), scores[full // repeats], *[s[full] for s in sums]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["place", "repeat", "score", "p", "a"])

    return pairs.mapInArrow(run, "place int, repeat int, score double, p double, a double")


def permutation_importance(model: GBTClassificationModel, df: DataFrame, features: list[str], tried: list[str] | None = None, repeats: int = 5) -> DataFrame:
    """feature, mean_drop, std_drop of average precision when a feature's values are permuted; the largest first.

    In each repeat every row is given another row as its donor. What a tree makes of a row are the ways it goes at splits, a bit each; only
    these bits are shuffled and paired with the donor's. All features and repeats are scored in one pass over the pairs, which
    walks again only the trees that split on a feature. A feature that no tree splits on changes no score, so its drops are 0 without scoring.
    """
    trees, splits = trees_of(model)
    split_on = {i for i, _ in splits}
    names = tried or features
    places = {features.index(n): n for n in names if features.index(n) in split_on}
    unused = F.array(*[F.lit(n) for n in names if features.index(n) not in split_on]).cast("array<string>")
    still = df.sparkSession.range(repeats).select(F.explode(unused).alias("feature"), F.lit(0.0).alias("dropped"))
    drops = still
    if places:
        plain = df.select("event_id", F.col("target").cast("double").alias("target"), F.col("sample_weight").cast("double").alias("sample_weight"), *[features[i] for i in sorted(split_on)])
        rows = stored(ways(plain, features, splits, ["event_id", "target", "sample_weight"]))
        found = stored(average_precisions_of_sums(permuted_sums(donated(rows, repeats), trees, splits, list(places), repeats), ["place", "repeat"]))
        base = found.where("repeat = -1").select(F.col("average_precision").alias("base"))
        named = F.element_at(F.create_map(*[F.lit(x) for pair in places.items() for x in pair]), F.col("place"))
        dropped = F.coalesce("base", F.lit(0.0)) - F.coalesce("average_precision", F.lit(0.0))
        drops = found.where("repeat >= 0").join(F.broadcast(base)).select(named.alias("feature"), dropped.alias("dropped")).unionByName(still)  # the other side is one row
    return drops.groupBy("feature").agg(F.avg("dropped").alias("mean_drop"), F.stddev_samp("dropped").alias("std_drop")).orderBy(F.desc("mean_drop"), "feature")


def save(model: GBTClassificationModel, features: list[str], path: str) -> None:
    """The model and the names of its features, in their order."""
    model.write().overwrite().save(f"{path}/model")
    write_settings(SparkSession.getActiveSession(), {"features": features}, f"{path}/features")


def load(spark: SparkSession, path: str) -> tuple[GBTClassificationModel, list[str]]:
    return GBTClassificationModel.load(f"{path}/model"), read_settings(spark, f"{path}/features", {})["features"]


def ranking_text(importance: DataFrame, top: int = 15) -> str:
    """The report: most and least important features. A row a feature is read."""
    ranked = importance.orderBy(F.desc("mean_drop"), "feature").collect()
    lines = ["| rank | feature | mean drop | deviation |", "|-|-|-|-|"]
    kept = list(enumerate(ranked, 1))
    for i, r in kept if len(kept) <= 2 * top else [*kept[:top], *kept[-top:]]:
        lines.append(f"| {i} | {r.feature} | {r.mean_drop:.6f} | {(r.std_drop or 0.0):.6f} |")
    return "\n".join(lines)


def write_importance(importance: DataFrame, path: str, top: int = 15) -> None:
    """The whole ranking as CSV, and the report as text."""
    importance.coalesce(1).orderBy(F.desc("mean_drop"), "feature").write.mode("overwrite").option("header", True).csv(f"{path}/ranking")
    importance.sparkSession.createDataFrame([(ranking_text(importance, top),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def write_trials(spark: SparkSession, trials: list[dict], path: str) -> dict:
    """Grid results as JSON lines and CSV, and the best settings, which are also returned."""
    table = spark.createDataFrame([(json.dumps({k: v for k, v in t.items() if k != "average_precision"}), t["average_precision"]) for t in trials], "settings string, average_precision double").coalesce(1)
    table.write.mode("overwrite").json(f"{path}/trials")
    table.write.mode("overwrite").option("header", True).csv(f"{path}/grid")
    best = {k: v for k, v in trials[0].items() if k != "average_precision"}
    write_settings(spark, best, f"{path}/best")
    return best
