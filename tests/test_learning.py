import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.operators import drift as D, evaluation as E, features as FE, learning as L, mmd


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    y = (np.arange(100) < 30).astype(int)
    x = rng.normal(size=(100, 2)) + y[:, None] * 3
    return spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1]), 1.0) for i in range(100)],
                                 "id BIGINT, y INT, a DOUBLE, b DOUBLE, c DOUBLE")


def test_split_keeps_class_shares(rows):
    got = {(r["y"], r["part"]): r["count"] for r in L.split_stratified(rows, "y", "id").groupBy("y", "part").count().collect()}
    assert got == {(1, "train"): 24, (1, "test"): 6, (0, "train"): 56, (0, "test"): 14}


def test_models_learn_and_importance_finds_the_signal(rows):
    data = L.training_rows(rows, "y", ["a", "b", "c"])
    models, table = L.train_all(data, data, ["logistic_regression", "linear_svc"], small=True)
    scores = {(r["model"], r["metric"]): r["value"] for r in table.collect()}
    assert scores["logistic_regression", "roc_auc"] > 0.95 and scores["linear_svc", "roc_auc"] > 0.95
    drop = {r["feature"]: r["importance_mean"] for r in L.permutation_importance(
        models["logistic_regression"], data, "id", ["a", "b", "c"], 2).collect()}
    assert drop["c"] == 0 and max(drop["a"], drop["b"]) > 0.01
    for name in ("f1_score", "recall", "neg_brier"):
        drop = {r["feature"]: r["importance_mean"] for r in L.permutation_importance(
            models["logistic_regression"], data, "id", ["a", "b", "c"], 2, scoring=name).collect()}
        assert drop["c"] == pytest.approx(0) and max(drop["a"], drop["b"]) > 0
    args = models["logistic_regression"], data, "id", ["a", "b", "c"], "a", 4
    curves = L.partial_dependence(*args, individual=True)
    mean = {r["value"]: r["m"] for r in curves.groupBy("value").agg(F.avg("prediction").alias("m")).collect()}
    assert curves.count() == 400 and mean == {r["value"]: pytest.approx(r["mean_prediction"]) for r in L.partial_dependence(*args).collect()}


def test_smote_balances_between_neighbours(rows):
    df = rows.select("id", "y", F.array("a", "b").alias("v"))
    out = L.smote(df, "id", "y", "v", 1).toPandas()
    assert (out["y"] == 1).sum() == 70
    real = np.stack(out[(out["y"] == 1) & ~out["synthetic"]]["v"])
    made = np.stack(out[out["synthetic"]]["v"])
    assert (made >= real.min(0) - 1e-9).all() and (made <= real.max(0) + 1e-9).all()


def test_scale_constant_column(rows):
    out = FE.scale(rows, ["a", "c"], "standard").agg(F.stddev_pop("a"), F.max("c")).first()
    assert out[0] == pytest.approx(1) and out[1] == 0


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y INT, s DOUBLE")
    assert E.roc_auc(df, [], F.col("y") == 1, "s").first()["roc_auc"] == pytest.approx(0.625)


def test_planted_drift_is_found(spark):
    rng = np.random.default_rng(4)
    vals = [(i, i >= 300, float(v)) for i, v in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(vals, "id BIGINT, cur BOOLEAN, same DOUBLE").withColumn(
        "moved", F.col("same") + F.when(F.col("cur"), 1.0).otherwise(0.0))
    got = {r["feature"]: r["drift_detected"] for r in D.feature_drift(
        D.long_features(df, ["cur"], ["same", "moved"]), F.col("cur")).collect()}
    assert got == {"same": False, "moved": True}
    for name, want in (("same", False), ("moved", True)):
        assert mmd.mmd_drift(df.withColumn("v", F.array(name)), "id", "v", F.col("cur")).first()["drift"] == want


def test_drift_probability_with_unequal_sides(spark):
    false_alarms = 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        vals = [(i, i >= 2000, float(v)) for i, v in enumerate(rng.normal(size=2040))]
        df = spark.createDataFrame(vals, "id BIGINT, cur BOOLEAN, x DOUBLE").coalesce(1)
        false_alarms += mmd.mmd_drift(df.withColumn("v", F.array("x")), "id", "v", F.col("cur"), seed=seed).first()["drift"]
        if seed < 2:
            moved = df.withColumn("v", F.array(F.col("x") + F.when(F.col("cur"), 1.0).otherwise(0.0)))
            assert mmd.mmd_drift(moved, "id", "v", F.col("cur"), seed=seed).first()["drift"]
    assert false_alarms <= 2
    one = mmd.mmd_drift(df.where("id < 2001").withColumn("v", F.array("x")), "id", "v", F.col("cur")).first()
    assert 0 < one["p_value"] <= 1


def test_smote_needs_two_rows(rows):
    df = rows.select("id", "y", F.array("a", "b").alias("v"))
    for few in (df.where("y = 0"), df.where("y = 0 OR id = 3")):
        with pytest.raises(ValueError):
            L.smote(few, "id", "y", "v", 1)


def test_counts_beyond_32_bits_per_class(spark):
    df = spark.createDataFrame([(1, 1, 4_000_000_000), (0, 1, 4_000_000_000), (0, 0, 4_000_000_000)], "y INT, p INT, n BIGINT")
    counted = df.select(F.lit("m").alias("g"), "y", "p", "n")
    per_class = lambda d, g, y, p: d.select(*g, F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).alias("predicted")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))).alias("s")).groupBy(
        *g, F.col("s.label").alias("label")).agg(F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"))
    before, E._per_class = E._per_class, per_class
    try:
        assert E.classification_metrics(counted, ["g"], "y", "p").first()["mcc"] == pytest.approx(0.5)
    finally:
        E._per_class = before
