import numpy as np
import pandas as pd
import pytest

from netsleuth.operators import iforest as IF


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(6000, 3))
    X[:30] += 7
    pdf = pd.DataFrame(X, columns=["a", "b", "c"])
    pdf["event_id"] = [f"{i:05d}" for i in range(len(pdf))]
    return spark.createDataFrame(pdf)


def test_fit_properties(spark, data, tmp):
    m = IF.fit(data, ["a", "b", "c"], n_trees=50)
    sc = m.score(data).toPandas()
    s = -(sc["anomaly_score"] + m.offset)
    assert ((s > 0) & (s < 1)).all()
    assert (sc["prediction"] == -1).mean() == pytest.approx(0.05, abs=0.005)
    lowest = sc.sort_values("anomaly_score").head(30)["event_id"].astype(int)
    assert (lowest < 30).all()
    again = IF.fit(data.repartition(7), ["a", "b", "c"], n_trees=50)
    assert again.nodes.equals(m.nodes) and again.offset == pytest.approx(m.offset)
    m.save(spark, tmp + "/model")
    loaded = IF.IsolationForestModel.load(spark, tmp + "/model")
    back = loaded.score(data).toPandas()
    assert np.allclose(back["anomaly_score"].to_numpy(), sc["anomaly_score"].to_numpy())


def test_small_table_uses_all_rows(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(40)], "event_id string, x double")
    m = IF.fit(df, ["x"], n_trees=10, max_samples=256)
    assert m.psi == 40
    assert (m.nodes[m.nodes.node_id == 0]["size"] == 40).all()
    assert IF.average_path_length([1, 2, 256]).tolist() == pytest.approx([0.0, 1.0, 10.2447], abs=1e-3)


def test_samples_are_uniform_and_bounded(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(8000, 2))
    X[:20] += 8
    pdf = pd.DataFrame(X, columns=["a", "b"])
    pdf["event_id"] = [f"{i:05d}" for i in range(len(pdf))]
    df = spark.createDataFrame(pdf)
    smp = IF.sample_for_trees(df, ["a", "b"], 8000, 20, 64, 42, "event_id").toPandas()
    assert (smp.groupby("tree").size() == 64).all() and not smp.duplicated(["tree", "_id"]).any()
    assert smp["_id"].nunique() > 1000
    m = IF.fit(df, ["a", "b"], n_trees=20, max_samples=64)
    sc = m.score(df).toPandas()
    assert (sc.sort_values("anomaly_score").head(20)["event_id"].astype(int) < 20).sum() >= 18
