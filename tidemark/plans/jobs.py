"""The jobs end to end: aggregates, training matrix, model, scores; each step reads what the one before stored.

    python -m tidemark.plans.jobs --root FOLDER [--steps aggregates matrix train score]
"""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import model, sampling, split
from tidemark.operators.audits import all_columns_there
from tidemark.plans import matrix
from tidemark.sources import aggregates, tables

STEPS = ("aggregates", "matrix", "train", "score")
# Test rows that a full score file has (the score step says whether it has them), and below the files' part names.
EXPECTED_ROWS = 633_683


@dataclass
class Paths:
    """Where a project's files are: below ``root``, unless TIDEMARK_<NAME> in the environment or an argument says otherwise."""

    root: str
    data: str = ""
    labels: str = ""
    aggregates: str = ""
    matrix: str = ""
    model: str = ""
    settings: str = ""
    scores: str = ""

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name != "root":
                given = getattr(self, f.name) or os.environ.get(f"TIDEMARK_{f.name.upper()}")
                setattr(self, f.name, given or f"{self.root}/{f.name}")

    def inputs(self) -> dict[str, list[str]]:
        parts = {p: [f"{self.data}/{p}_part_{i}.parquet" for i in (1, 2, 3)] for p in ("pretrain", "train")}
        return parts | {p: [f"{self.data}/{p}.parquet"] for p in ("pretest", "test")}


def read_inputs(spark: SparkSession, paths: Paths) -> DataFrame:
    """All transactions with their labels; a row is labelled if its event id is among the labels, whatever the target."""
    tx = tables.conform(tables.read_transactions(spark, paths.inputs()))
    ids = tables.read_label_ids(spark, paths.labels).join(tables.read_labels(spark, paths.labels), "event_id", "left")
    marked = tx.join(ids.withColumnRenamed("label", "_label").selectExpr("event_id", "_label", "true AS _known"), "event_id", "left")
    return marked.selectExpr("* EXCEPT (_label, _known)", "coalesce(_known, false) AS labelled", "_label AS label")


def run(spark: SparkSession, paths: Paths, tx: DataFrame | None = None, steps: tuple[str, ...] = STEPS) -> DataFrame | None:
    """Runs the steps in their order; the score step's rows (event_id, predict) are stored as CSV and returned as read back."""
    rows = read_inputs(spark, paths) if tx is None else tx
    out = None
    for step in [s for s in STEPS if s in steps]:
        if step == "aggregates":
            aggregates.write(rows, paths.aggregates)
        elif step == "matrix":
            past = rows.where("phase = 'pretest'")
            tables.write_matrix(matrix.training_matrix(rows, sampling.length_distribution(past), fitted=aggregates.read(spark, paths.aggregates)), f"{paths.matrix}/full_dataset.parquet")
        elif step == "train":
            train = split.with_split(tables.load_matrix(spark, paths.matrix))
            names = tables.feature_columns(train.drop("t", "validation"))
            model.save(model.train(train, names, **tables.read_settings(spark, paths.settings, model.DEFAULTS)), names, paths.model)
        else:
            fitted, names = model.load(spark, paths.model)
            ready = matrix.scoring_rows(rows, aggregates.read(spark, paths.aggregates))
            if faults := all_columns_there(ready.drop("event_id"), names):
                raise ValueError("; ".join(faults))
            out = tables.write_predictions(model.scored(fitted, ready, names), paths.scores)
            if out.count() != EXPECTED_ROWS:
                print(f"{paths.scores}: not the {EXPECTED_ROWS} rows expected of a full test set")
    return out


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--root", required=True)
    parser.add_argument("--steps", nargs="+", choices=STEPS, default=STEPS)
    given = parser.parse_args()
    run(SparkSession.builder.getOrCreate(), Paths(given.root), steps=tuple(given.steps))


if __name__ == "__main__":
    main()
