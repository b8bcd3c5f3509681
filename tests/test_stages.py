from pyspark.ml import Pipeline, PipelineModel

from trustloom.operators.stages import KeyStats, TextMeasures
from trustloom.plans.views import Tables
from trustloom.session import scratch_path


def test_statistics_come_from_the_training_rows_and_survive_saving(spark, small):
    rows = Tables(spark, small).reviews().select("review_id", "user_id", "product_id", "rating", "review_text")
    train, new = rows.where("review_id % 2 = 0"), rows.where("review_id % 2 = 1")
    model = Pipeline(stages=[TextMeasures(), KeyStats(), KeyStats(keyCol="product_id", prefix="product")]).fit(train)
    path = scratch_path(spark, "pipeline")
    model.write().overwrite().save(path)
    a = model.transform(new).drop("review_text").collect()
    loaded = PipelineModel.load(path)
    assert all(s.getOrDefault("table").startswith(path) for s in loaded.stages[1:])  # nothing outside the saved model is needed
    b = loaded.transform(new).drop("review_text").collect()
    assert sorted(a) == sorted(b)
    seen = {r["user_id"]: r["count"] for r in train.groupBy("user_id").count().collect()}
    assert all(r["user_rating_count"] == seen.get(r["user_id"], 0) for r in a)
