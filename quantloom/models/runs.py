"""Whole runs: training, walk-forward training and the storing of a backtest, each written as tables of one version."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.backtest import Backtest
from ..operators.labels import chronological_splits, forward_labels, prepare_features, split_summary, walk_forward_folds
from ..operators.metrics import evaluate, factor_ic_report, oos_cumulative, oos_daily_returns, oos_totals, selection_guide
from ..schemas import FEATURES, MODEL_COLUMNS, TARGET, column_names
from ..session import materialize
from ..sinks.snapshots import read_table
from ..sinks.tables import replace_model_version, replace_table, upsert_table
from .registry import registry_row
from . import boosting
from .trees import BOOSTED, SEED, ensemble_predict, ensemble_weights, feature_importance, fit_models, walk_forward_predict

def save_models(models: dict, folder: str) -> None:
    """Boosted models as tables of their nodes, the forest in `pyspark.ml`'s form."""
    for name, model in models.items():
        if name in BOOSTED:
            model.save(SparkSession.active(), f"{folder}/{name}")
        else:
            model.write().overwrite().save(f"{folder}/{name}")


def load_models(folder: str, names: Sequence[str] = tuple(MODEL_COLUMNS)) -> dict:
    spark = SparkSession.active()
    return {
        name: boosting.load(spark, f"{folder}/{name}", FEATURES, BOOSTED[name]) if name in BOOSTED else RandomForestRegressionModel.load(f"{folder}/{name}")
        for name in names
    }


@dataclass(frozen=True)
class ModelRun:
    """What a run wrote: rows of `model_predictions`, metrics by split, and its reports by name."""

    version: str
    artifact_dir: str
    predictions: DataFrame
    metrics: DataFrame
    reports: dict[str, DataFrame]


def _finish(
    spark: SparkSession, version: str, folder: str, scored: DataFrame, splits: DataFrame, out_of_sample: DataFrame,
    reports: dict[str, DataFrame], params: dict[str, str],
) -> ModelRun:
    """Write predictions, metrics and reports of a version, and its registry row last."""
    artifacts = f"{folder}/artifacts/{version}"
    daily = materialize(oos_daily_returns(out_of_sample), "oos")
    reports = reports | {
        "metrics": evaluate(splits, by=["split"]), "oos_daily_returns": daily, "oos_totals": oos_totals(oos_cumulative(daily)),
        "selection_guide": selection_guide(scored),
    }
    for name, report in reports.items():
        replace_table(report, f"{artifacts}/{name}")
    stored = {name: read_table(spark, f"{artifacts}/{name}") for name in reports}
    rows = scored.withColumn("model_version", F.lit(version)).select(*column_names("model_predictions"))
    replace_model_version(rows, f"{folder}/model_predictions", version)
    # A row for each of at most four splits.
    by_split = {row["split"]: row for row in stored["metrics"].collect()}
    numbers = {f"{s}_{c}": float(row[c]) for s, row in by_split.items() for c in ("mse", "rmse", "ic", "rank_ic", "hit_rate") if row[c] is not None}
    row = registry_row(spark, version, split_summary(splits), params, numbers, artifacts)
    upsert_table(spark, f"{folder}/model_registry", row.withColumn("version_folder", F.lit(version)), ["model_version"], "version_folder")
    predictions = read_table(spark, f"{folder}/model_predictions").where(F.col("model_version") == version)
    return ModelRun(version, artifacts, predictions.select(*column_names("model_predictions")), stored["metrics"], stored)


def train_models(
    factors: DataFrame, prices: DataFrame, version: str, folder: str, names: Sequence[str] = tuple(MODEL_COLUMNS), rounds: int = 500,
    trees: int = 300, seed: int = SEED, **split_options,
) -> ModelRun:
    """Label, split, fit, weigh by validation, predict every prepared row, and report out of sample.

    The final holdout is the out-of-sample part, or the test split where there is no holdout. Models are saved beside
    the reports, in `<folder>/artifacts/<version>`; `load_models` reads them back.
    """
    spark = factors.sparkSession
    dataset = materialize(prepare_features(forward_labels(factors, prices)), "dataset")
    split = materialize(chronological_splits(dataset, **split_options), "splits")
    models = fit_models(split.where("split = 'train'"), names, rounds, trees, seed)
    save_models(models, f"{folder}/artifacts/{version}/models")
    weights = ensemble_weights(split.where("split = 'validation'"), models)
    scored = materialize(ensemble_predict(dataset, models, weights), "scored")
    splits = materialize(ensemble_predict(split, models, weights), "scored-splits")
    held = splits.where("split = 'final_holdout'")
    reports = {
        "factor_ic_report": factor_ic_report(dataset), "feature_importance": feature_importance(models, spark),
        "split_summary": split_summary(split),
        "ensemble_weights": spark.createDataFrame(list(weights.items()), "model string, weight double"),
    }
    out_of_sample = splits.where("split = 'test'") if held.isEmpty() else held
    params = {"rounds": str(rounds), "trees": str(trees), "seed": str(seed)}
    return _finish(spark, version, folder, scored, splits, out_of_sample, reports, params)


def train_walk_forward(
    factors: DataFrame, prices: DataFrame, version: str, folder: str, names: Sequence[str] = tuple(MODEL_COLUMNS), rounds: int = 500,
    trees: int = 300, seed: int = SEED, **fold_options,
) -> ModelRun:
    """Predictions of every fold by models of the dates before it, with a report of the folds; options as `walk_forward_folds`.

    In the registry, the dates before the first fold are the training split, those of the holdout the test split (all
    predicted dates where there is no holdout) and the rest validation.
    """
    spark = factors.sparkSession
    dataset = materialize(prepare_features(forward_labels(factors, prices)), "dataset")
    labelled = dataset.where(F.col(TARGET).isNotNull())
    folds = materialize(walk_forward_folds(labelled, **fold_options), "folds")
    scored = materialize(walk_forward_predict(dataset, folds, names, rounds, trees, seed), "scored")
    bounds = folds.agg(F.min("predict_start").alias("start"), F.min("holdout_start").alias("holdout")).first()
    known = scored.where(F.col(TARGET).isNotNull())
    if bounds["holdout"] is None:
        predicted = known.withColumn("split", F.lit("test"))
    else:
        predicted = known.withColumn("split", F.when(F.col("date") >= F.lit(bounds["holdout"]), "test").otherwise("validation"))
    before = labelled.where(F.col("date") < F.lit(bounds["start"])).withColumn("split", F.lit("train"))
    splits = materialize(predicted.unionByName(before, allowMissingColumns=True), "scored-splits")
    counts = scored.groupBy(F.col("walk_forward_fold").alias("fold")).agg(F.count(F.lit(1)).alias("prediction_rows"))
    # One row for each date, so bounded by the calendar.
    by_date = labelled.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    trained = folds.select("fold", "train_end").join(by_date, F.col("date") <= F.col("train_end")).groupBy("fold").agg(
        F.sum("n").alias("train_rows")
    )
    report = folds.join(trained, "fold").join(counts, "fold")
    params = {"rounds": str(rounds), "trees": str(trees), "seed": str(seed)}
    return _finish(spark, version, folder, scored, splits, splits.where("split = 'test'"), {"folds": report}, params)


def store_backtest(run: Backtest, version: str, folder: str) -> dict[str, str]:
    """Replace every table of a backtest version; a table without rows leaves an empty version. Returns the paths."""
    paths = {}
    for field in fields(Backtest):
        if field.name in BACKTEST_TABLES:
            name = BACKTEST_TABLES[field.name]
            paths[name] = f"{folder}/{name}"
            replace_model_version(getattr(run, field.name).withColumn("model_version", F.lit(version)), paths[name], version)
    return paths


#: Parts of a backtest and the tables that hold them.
BACKTEST_TABLES = {
    "signals": "trading_signals", "positions": "portfolio_positions", "results": "backtest_results", "trades": "trades",
    "orders": "execution_orders", "fills": "execution_fills", "current_positions": "current_positions",
}
