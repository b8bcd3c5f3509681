import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trustloom.operators import ordered as O


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    n = 400
    t = np.where(np.arange(n) < 140, 7, rng.integers(0, 60, n))  # a third of the rows share one order key
    return pd.DataFrame({"g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)), "t": t,
                         "id": rng.permutation(n), "x": rng.integers(0, 5, n)})


def test_row_numbers(spark, rows):
    got = O.row_numbers(spark.createDataFrame(rows), ["g"], ["t", "id"], n=5).toPandas()
    want = rows.sort_values(["t", "id"])
    want["w"] = want.groupby("g").cumcount() + 1
    both = got.merge(want[["id", "w"]], on="id")
    assert len(both) == len(rows) and (both["rn"] == both["w"]).all()


def test_hot_order_key_gets_shards_of_its_own(spark, rows):
    shards = O.with_shards(spark.createDataFrame(rows), ["t", "id"], 8).groupBy("_shard").count().toPandas()
    assert shards["count"].max() < 140


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, rows, descending):
    got = O.running_sums(spark.createDataFrame(rows), ["g"], "t", ["x"], descending, n=5).toPandas()
    want = rows.groupby(["g", "t"])["x"].sum().reset_index().sort_values("t", ascending=not descending)
    want["w"] = want.groupby("g")["x"].cumsum()
    both = got.merge(want[["g", "t", "w"]], on=["g", "t"])
    assert len(both) == len(want) and (both["run_x"] == both["w"]).all()


def test_rolling_rows(spark, rows):
    numbered = O.row_numbers(spark.createDataFrame(rows), ["g"], ["t", "id"], n=5)
    got = O.rolling_rows(numbered, ["g"], 7, {"s": F.sum("x"), "n": F.count("*")}).toPandas()
    want = rows.sort_values(["t", "id"])
    want["w"] = want.groupby("g")["x"].transform(lambda v: v.rolling(7, min_periods=1).sum())
    both = got.merge(want[["id", "w"]], on="id")
    assert len(both) == len(rows) and (both["s"] == both["w"]).all() and both["n"].max() == 7


def test_quantiles(spark, rows):
    probs = [0.0, 0.05, 0.33, 0.5, 1.0]
    got = O.quantiles(spark.createDataFrame(rows), ["g"], "t", probs, n=5).toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        assert got.loc[g].tolist() == pytest.approx(np.quantile(part["t"], probs).tolist())


@pytest.mark.parametrize("hot_rows", [1, 50, 10**9])
def test_attach_is_a_left_join_whatever_is_hot(spark, rows, hot_rows):
    df = spark.createDataFrame(rows).withColumn("g", F.when(F.col("id") % 10 > 0, F.col("g")))
    stats = df.where("g <> 'a'").groupBy("g").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    got = {r["id"]: (r["n"], r["s"]) for r in O.attach(df, stats, "g", "id", "n", hot_rows).collect()}
    want = {r["id"]: (r["n"], r["s"]) for r in df.join(stats, "g", "left").collect()}
    assert got == want


def test_the_salt_reaches_the_shuffle(spark, rows):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(rows)
        stats = df.groupBy("g").agg(F.count("*").alias("n"))
        plan = O.attach(df, stats, "g", "id", "n", 50)._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
        assert joins and all(line.count("_salt") == 2 for line in joins)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a", 1, 10), (None, 1, 11), (None, 2, 12), ("a", 2, 13), (None, 2, 14)], "g STRING, t INT, id INT")
    got = {r["id"]: r["rn"] for r in O.row_numbers(df, ["g"], ["t", "id"], n=3).collect()}
    assert got == {10: 1, 13: 2, 11: 1, 12: 2, 14: 3}
    sums = {(r["g"], r["t"]): r["run_id"] for r in O.running_sums(df, ["g"], "t", ["id"], n=3).collect()}
    assert sums == {("a", 1): 10, ("a", 2): 23, (None, 1): 11, (None, 2): 37}
    mid = {r["g"]: r["q0"] for r in O.quantiles(df, ["g"], "t", [0.5], n=3).collect()}
    assert mid == {"a": 1.5, None: 2.0}


def test_positions_where_the_second_key_is_a_text(spark):
    """More shards than first keys: a frequent one is cut along texts, in their order, whatever they begin with; null texts too."""
    rows = [(h, f"{p}{i}") for h in (1, 2, 3) for p in ("product_src", "é", "9", "10", "") for i in range(9)] + [(2, "x"), (2, None)]
    df = spark.createDataFrame(rows, "h long, t string")
    for order in (["h", "t"], ["t", "h"]):
        key = lambda r: tuple((r[c] is not None, r[c].encode() if isinstance(r[c], str) else r[c] or 0) for c in order)  # noqa: B023, E731
        got = sorted(O.row_numbers(df.where("t is not null"), [], order, 50).collect(), key=lambda r: r.rn)
        assert [r.rn for r in got] == list(range(1, len(rows))) and got == sorted(got, key=key)
    assert O.row_numbers(df, [], ["h", "t"], 50).agg({"rn": "max"}).first()[0] == len(rows)
