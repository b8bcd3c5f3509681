import datetime as dt

import pytest
from pyspark.sql import functions as F

from trustloom.operators import behaviour as B

DDL = "review_id BIGINT, user_id STRING, product_id STRING, rating DOUBLE, review_text STRING, date TIMESTAMP"


def at(hours):
    return dt.datetime(2023, 1, 1, 10) + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(1, "a", "p", 5.0, "x", at(0)), (2, "a", "p", 1.0, "xx", at(0.5)), (3, "a", "q", 3.0, "xxx", at(0.5)),
            (4, "a", "q", None, None, at(90)), (5, "b", "p", 4.0, "x", at(1)), (6, "b", "p", 2.0, "x", None),
            (7, None, "p", 2.0, "x", at(2)), (8, None, "p", 2.0, "x", at(2.1)), (9, "c", "p", 5.0, "x", at(24 * 4000))]
    return spark.createDataFrame(rows, DDL)


@pytest.mark.parametrize("width", [60, 3600, 10**9])
def test_gaps_do_not_depend_on_the_bucket(reviews, width):
    got = {r["review_id"]: r["gap_hours"] for r in B.with_gap_hours(reviews, width=width).collect()}
    assert got == {1: None, 2: 0.5, 3: 0.0, 4: 89.5, 5: None, 6: None, 7: None, 8: None, 9: None}


def test_anomalies(reviews):
    got = {r["review_id"]: r["temporal_anomaly_type"] for r in B.with_temporal_anomaly(
        reviews, F.lit("2023-06-01").cast("timestamp")).collect()}
    assert got[2] == got[3] == "too_frequent" and got[9] == "future_date" and got[1] is None and got[4] is None


def test_key_stats_fill_and_null_keys(reviews):
    got = {r["review_id"]: r for r in B.with_key_stats(reviews, "user_id", "u", hot_rows=2).collect()}
    assert got[1]["u_rating_count"] == 4 and got[1]["u_rating_mean"] == pytest.approx((5 + 1 + 3 + 0) / 4)
    assert got[9]["u_rating_std"] == 0 and got[7]["u_rating_count"] == 0


def test_rolling_and_bursts(reviews):
    got = {r["review_id"]: r for r in B.rolling_activity(reviews).collect()}
    assert got[3]["reviews_1h"] == 3 and got[4]["reviews_1h"] == 1 and got[4]["reviews_168h"] == 4
    assert got[6]["reviews_1h"] is None
    bursts = B.review_bursts(reviews).collect()
    assert [(r["user_id"], r["reviews"]) for r in bursts] == [("a", 3)]


def test_user_temporal(reviews):
    got = {r["user_id"]: r for r in B.user_temporal(reviews).collect()}
    assert got["a"]["reviews_in_1_hour"] == 2 and got["a"]["most_active_hour"] == 10 and got["c"]["avg_time_between_reviews"] == 0


@pytest.mark.parametrize("hot_rows", [5, 10**9])
def test_many_reviews_at_one_instant(spark, hot_rows):
    rows = [(i, "hot" if i % 3 else None, "p", 5.0, "x", at(0 if i < 300 else i)) for i in range(400)]
    got = {r["review_id"]: r["gap_hours"] for r in B.with_gap_hours(spark.createDataFrame(rows, DDL), hot_rows=hot_rows).collect()}
    assert len(got) == 400 and got[1] is None and all(got[i] == 0 for i in range(2, 300) if i % 3)
    assert got[301] == 301 - 0 and got[302] == 1 and got[304] == 2 and all(got[i] is None for i in range(0, 400, 3))
    bursts = B.review_bursts(spark.createDataFrame(rows, DDL)).collect()
    assert [(r["user_id"], r["reviews"]) for r in bursts if r["reviews"] > 2] == [("hot", 200)]
