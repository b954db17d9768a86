"""Sliced and sampled ways through large groups must equal the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import groups as G


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    n = 3000
    data = pd.DataFrame({
        "d": rng.choice([1, 1, 1, 2, 3], n), "k": [f"t{i:05d}" for i in range(n)], "x": rng.normal(size=n),
        # One value holds half of the rows.
        "y": np.where(rng.random(n) < 0.5, 0.0, rng.normal(size=n).round(1)),
    })
    data.loc[rng.random(n) < 0.05, "x"] = np.nan
    return data, spark.createDataFrame(data).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).cache()


@pytest.mark.parametrize("by,value,descending", [(["d"], "y", True), ([], "x", False), ([], "x", True)])
def test_ordinal(frame, by, value, descending):
    plain, sliced = (
        G.ordinal(frame[1], by, value, ["k"], "r", descending, max_rows=rows).orderBy("k").toPandas() for rows in (10**6, 100)
    )
    assert (plain.r == sliced.r).all()


def test_average_rank(frame):
    data = frame[0].sort_values("k")
    for rows in (10**6, 100):
        ranked = G.average_rank(frame[1], ["d"], ["x", "y"], ["k"], max_rows=rows).orderBy("k").toPandas()
        for column in ("x", "y"):
            expected = data.groupby("d")[column].rank()
            assert np.allclose(ranked[f"{column}_rank"], expected, equal_nan=True)


def test_ranks_over_many_slices(spark):
    """A value longer than several slices, a constant group, NULL values, a NULL group and a group within one slice."""
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"d": ["a"] * 700 + ["b"] * 400 + [None] * 300 + ["c"] * 7, "k": np.arange(1407)})
    data["v"] = np.where(rng.random(1407) < 0.6, 3.0, rng.integers(0, 6, 1407).astype(float))
    data.loc[data.d == "b", "v"] = -0.0
    data.loc[rng.random(1407) < 0.1, "v"] = np.nan
    frame = spark.createDataFrame(data.astype({"d": object})).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    ranked = G.average_rank(frame, ["d"], ["v"], ["k"], max_rows=40).orderBy("k").toPandas()
    assert np.allclose(ranked["v_rank"], data.groupby("d", dropna=False)["v"].rank(), equal_nan=True)
    pooled = G.average_rank(frame, [], ["v"], ["k"], max_rows=40).orderBy("k").toPandas()
    assert np.allclose(pooled["v_rank"], data["v"].rank(), equal_nan=True)
    place = G.ordinal(frame, ["d"], "v", ["k"], "r", max_rows=40).orderBy("k").toPandas().r
    expected = data.sort_values(["v", "k"], ascending=[False, True]).groupby("d", dropna=False).cumcount() + 1
    assert (place.to_numpy() == expected.sort_index().to_numpy()).all()


def test_quantiles(frame, monkeypatch):
    monkeypatch.setattr(G, "BRACKET_SAMPLE", 60)
    data = frame[0]
    for rows in (10**6, 800, 100):
        found = G.group_quantiles(frame[1], ["d"], ["x", "y"], [0.01, 0.5, 0.99], ["k"], max_rows=rows).collect()
        for row in found:
            group = data[data.d == row["d"]]
            for column in ("x", "y"):
                assert np.allclose(row[f"q_{column}"], group[column].quantile([0.01, 0.5, 0.99]))
                assert row[f"n_{column}"] == group[column].notna().sum()
