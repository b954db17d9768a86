"""Registry of trained models and the window in which each may be tested."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEATURES, KEYS, TABLES, column_names
from ..sinks.tables import upsert_by_key


def registry_row(
    spark: SparkSession, version: str, summary: DataFrame, params: dict[str, str], metrics: dict[str, float],
    artifact_dir: str = "", notes: str = "", trained_at: datetime | None = None,
) -> DataFrame:
    """One registry row from a `split_summary` of at most four rows."""
    splits = {row["split"]: row for row in summary.collect()}

    def bound(split: str, side: str):
        return splits[split][side] if split in splits else None

    moment = trained_at or datetime.now(timezone.utc).replace(tzinfo=None)
    holdout_rows = splits["final_holdout"]["rows"] if "final_holdout" in splits else 0
    values = [version, moment]
    for split in ("train", "validation", "test", "final_holdout"):
        values += [bound(split, "start_date"), bound(split, "end_date")]
    values += [holdout_rows, FEATURES, params, metrics, artifact_dir, notes]
    return spark.createDataFrame([tuple(values)], TABLES["model_registry"])


def register_model(registry: DataFrame, row: DataFrame) -> DataFrame:
    return upsert_by_key(registry.select(*column_names("model_registry")), row, KEYS["model_registry"])


def latest_model(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("trained_at"), F.desc("model_version")).limit(1).select("model_version")


def oos_window(registry: DataFrame, version: str) -> DataFrame:
    """The final holdout of a version if it has rows, else its test window."""
    held_out = (F.coalesce("holdout_rows", F.lit(0)) > 0) & F.col("holdout_start").isNotNull() & F.col("holdout_end").isNotNull()
    return registry.where(F.col("model_version") == version).select(
        "model_version",
        F.when(held_out, F.col("holdout_start")).otherwise(F.col("test_start")).alias("test_start"),
        F.when(held_out, F.col("holdout_end")).otherwise(F.col("test_end")).alias("test_end"),
        "artifact_dir",
        F.when(held_out, "final_holdout").otherwise("test").alias("oos_window_type"),
    )
