import pytest
from pyspark.sql import functions as F

from trustloom.operators import quality as Q
from trustloom.sources import conform as N, models as M, readers as R, writers as O
from trustloom.session import scratch_path


def test_validate_keeps_the_one_valid_row(spark):
    rows = [("r1", "short", 3.0), ("r2", "x" * 6000, 10.0), ("r3", "a perfectly valid review", 4.0), ("r4", "", 5.0),
            ("r5", None, 2.0), ("r3", "a later copy of the review", 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no INT, review_id STRING, review_text STRING, rating DOUBLE")
    kept = Q.validate_reviews(df, "row_no").collect()
    assert [(r["review_id"], r["row_no"]) for r in kept] == [("r3", 2)]
    good, bad = Q.split(df, Q.review_rules(df))
    assert good.count() + bad.count() == df.count()


def test_businesses_dedupe_before_filter(spark):
    df = spark.createDataFrame([(0, "b1", None), (1, "b1", "late"), (2, "b2", "ok"), (3, None, "x")],
                               "row_no INT, business_id STRING, name STRING")
    assert [r["business_id"] for r in Q.validate_businesses(df, "row_no").collect()] == ["b2"]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        Q.handle_missing_text(spark.range(1), "id", "guess")


def test_all_bad_lines_is_an_error(spark):
    path = scratch_path(spark, "bad")
    spark.createDataFrame([("{no",), ("json",)], "value STRING").write.text(path)
    rows = R.json_lines(spark, path, "a INT")
    assert R.quarantine(rows).count() == 2
    with pytest.raises(R.NoRecordsError):
        R.require_rows(rows)


def test_shop_dialects_meet(spark):
    old = spark.createDataFrame([("1", "p", 4.0, "t", 1_600_000_000)], "Id STRING, ProductId STRING, Score DOUBLE, Text STRING, Time BIGINT")
    both = N.shop_reviews(N.concat([old, old.toDF("Id", "asin", "overall", "reviewText", "unixReviewTime")]))
    assert {(r["product_id"], r["rating"], r["review_text"], r["timestamp"]) for r in both.collect()} == {("p", 4.0, "t", 1_600_000_000)}


def test_csv_round_trip_with_line_breaks(spark):
    df = spark.createDataFrame([("a", 'line "one"\nline, two')], "id STRING, text STRING")
    assert R.csv(spark, O.csv(df, scratch_path(spark, "csv")), "id STRING, text STRING", multi_line=True).collect() == df.collect()


def test_latest_state(spark):
    path = scratch_path(spark, "state")
    for v, day in ((1, "2024-01-02"), (2, "2024-01-01")):
        M.append_state(spark.createDataFrame([("m", v)], "name STRING, v INT").withColumn("ts", F.lit(day).cast("timestamp")), path)
    assert M.latest_state(spark, path, ["name"], "ts").first()["v"] == 1


def test_content_items_overwrite_and_fill_metadata(spark):
    from trustloom.sources import conform

    df = spark.createDataFrame([("a", {"content_id": "old", "k": "v"}), ("b", None)], "text STRING, metadata MAP<STRING, STRING>")
    got = {r["text"]: r["metadata"] for r in conform.content_items(df).collect()}
    assert got["a"]["content_id"] != "old" and got["a"]["k"] == "v" and set(got["b"]) == {"content_id", "collected_at"}
