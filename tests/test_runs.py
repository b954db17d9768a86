import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.models import runs as R
from quantloom.models import trees as T
from quantloom.operators.labels import forward_labels, prepare_features
from quantloom.schemas import FEATURES
from quantloom.sinks.snapshots import read_table


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    days = [dt.date(2021, 3, 1) + dt.timedelta(days=d) for d in range(48)]
    names = ["SPY", *(f"t{i}" for i in range(12))]
    factors = [(day, name, *map(float, rng.normal(size=len(FEATURES)))) for day in days for name in names[1:]]
    prices = [(day, name, float(50 + rng.uniform())) for day in days for name in names]
    schema = "date date, ticker string, " + ", ".join(f"{c} double" for c in FEATURES)
    return spark.createDataFrame(factors, schema).cache(), spark.createDataFrame(prices, "date date, ticker string, close double").cache()


def test_training_run_is_stored_and_read_back(spark, tables, tmp_path):
    folder = str(tmp_path)
    for _ in range(2):  # a version run again replaces its rows
        run = R.train_models(*tables, "v1", folder, names=("rf",), trees=3)
    dataset = prepare_features(forward_labels(*tables))
    assert run.predictions.count() == dataset.count() == 48 * 12
    models = R.load_models(f"{run.artifact_dir}/models", ("rf",))
    again = T.ensemble_predict(dataset, models).select("date", "ticker", "rf_pred").join(
        run.predictions.select("date", "ticker", F.col("rf_pred").alias("stored")), ["date", "ticker"]
    )
    assert again.where("abs(rf_pred - stored) < 1e-12").count() == 48 * 12
    registry = read_table(spark, f"{folder}/model_registry").collect()
    assert [r["model_version"] for r in registry] == ["v1"] and registry[0]["artifact_dir"] == run.artifact_dir
    assert {r["split"] for r in run.metrics.collect()} >= {"train", "validation"} and run.reports["ensemble_weights"].count() == 1


def test_walk_forward_run_reports_its_folds(spark, tables, tmp_path):
    run = R.train_walk_forward(*tables, "w1", str(tmp_path), names=("rf",), trees=2, min_train_days=30, step_days=8)
    folds = run.reports["folds"].orderBy("fold").collect()
    assert [f["train_rows"] for f in folds] == [12 * f["train_dates"] for f in folds]
    assert sum(f["prediction_rows"] for f in folds) == run.predictions.count()
    assert read_table(spark, f"{tmp_path}/model_registry").count() == 1
