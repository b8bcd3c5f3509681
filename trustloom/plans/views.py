"""Review-shaped views over the base tables, once as DataFrames and once as SQL for the twins.

``date`` columns are converted to ``TIMESTAMP`` here, once, because watermarks and epoch functions
do not take ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The instant "now" stands for in repeatable runs, inside the span of the event table.
NOW = "2024-01-25 00:00:00"

REVIEWS_SQL = """
SELECT d.doc_id AS review_id, e.user_id, d.source AS product_id, CAST(1 + d.doc_id % 5 AS DOUBLE) AS rating,
       d.text AS review_text, e.ts AS date, d.lang, 1 - l.quality AS is_fake, l.toxic
FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

PURCHASES_SQL = """
SELECT o.o_custkey AS user_id, l.l_partkey AS product_id,
       CAST(1 + floor((l.l_quantity - 1) / 10) AS DOUBLE) AS rating, o.o_orderdate AS date, l.l_shipdate AS shipped
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

SCORED_SQL = """
SELECT event_id AS prediction_id, user_id, ts, event_type AS class_label,
       CASE event_type WHEN 'purchase' THEN 'ecommerce' WHEN 'view' THEN 'social_media'
            WHEN 'click' THEN 'app_store' WHEN 'signup' THEN 'review_site' ELSE 'general' END AS platform,
       CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS p_fake,
       CASE WHEN (event_id * 7919) % 1000 >= 500 THEN 1 ELSE 0 END AS y_pred,
       CASE WHEN ((event_id * 7919) % 1000 + (user_id * 31) % 400 - 200) >= 500 THEN 1 ELSE 0 END AS y_true,
       value
FROM events
"""


def with_views(body: str, *, reviews=False, purchases=False, scored=False, extra: str = "") -> str:
    """Prefix ``body`` with the views it names."""
    parts = []
    if reviews:
        parts.append(f"reviews_v AS ({REVIEWS_SQL})")
    if purchases:
        parts.append(f"purchases_v AS ({PURCHASES_SQL})")
    if scored:
        parts.append(f"scored_v AS ({SCORED_SQL})")
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def r6(expr: str) -> str:
    """SQL for rounding a double to six places with the same arithmetic as :func:`round6`."""
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def round6(col):
    """Round a double column to six places (plain IEEE steps, so any engine gives the same value)."""
    col = F.col(col) if isinstance(col, str) else col
    return (F.floor(col * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).cast("double")


class Tables:
    """Lazy access to the base tables of one data folder and to the views over them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def texts(self, name: str, key: str) -> DataFrame:
        """A base table with long texts, read as it is. Where its files give too few tasks, the session may name a number
        of partitions to deal the rows to (``trustloom.text.partitions``); nothing is looked up or decided here."""
        df = self.base(name)
        parts = self.spark.conf.get("trustloom.text.partitions", None)
        return df.repartition(int(parts), key) if parts else df

    def events(self) -> DataFrame:
        return self.base("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def reviews(self) -> DataFrame:
        d, e, lab = self.texts("documents", "doc_id"), self.events(), self.base("labels")
        return (
            d.join(e, e.event_id == d.doc_id)
            .join(lab.withColumnRenamed("doc_id", "label_id"), F.col("label_id") == F.col("doc_id"), "left")
            .select(
                F.col("doc_id").alias("review_id"), "user_id", F.col("source").alias("product_id"),
                (1 + F.col("doc_id") % 5).cast("double").alias("rating"),
                F.col("text").alias("review_text"), F.col("ts").alias("date"), "lang",
                (1 - F.col("quality")).alias("is_fake"), "toxic",
            )
        )

    def purchases(self) -> DataFrame:
        li, o = self.base("lineitem"), self.base("orders")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"),
            (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
            F.col("o_orderdate").cast("timestamp").alias("date"),
            F.col("l_shipdate").cast("timestamp").alias("shipped"),
        )

    def scored(self) -> DataFrame:
        key = (F.col("event_id") * 7919) % 1000
        return self.events().select(
            F.col("event_id").alias("prediction_id"), "user_id", "ts", F.col("event_type").alias("class_label"),
            F.when(F.col("event_type") == "purchase", "ecommerce").when(F.col("event_type") == "view", "social_media")
            .when(F.col("event_type") == "click", "app_store").when(F.col("event_type") == "signup", "review_site")
            .otherwise("general").alias("platform"),
            (key.cast("double") / 1000).alias("p_fake"),
            F.when(key >= 500, 1).otherwise(0).alias("y_pred"),
            F.when(key + (F.col("user_id") * 31) % 400 - 200 >= 500, 1).otherwise(0).alias("y_true"),
            "value",
        )

    def now(self):
        return F.lit(NOW).cast("timestamp")
