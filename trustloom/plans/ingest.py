"""Sources, sinks and conforming. Files are landed from the tables by Spark in the shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom import schema as S
from trustloom.plans.registry import query
from trustloom.plans.scalars import requests, REQUESTS_SQL
from trustloom.plans.views import NOW, with_views
from trustloom.session import scratch_path
from trustloom.sources import conform as N, readers as R, writers as O

C = F.col
STAMP = "yyyy-MM-dd HH:mm:ss"


def landed_reviews(t):
    """Reviews in the shape of the open review dump."""
    rid = C("review_id")
    return t.reviews().select(
        rid.cast("string").alias("review_id"), C("user_id").cast("string").alias("user_id"),
        C("product_id").alias("business_id"), C("rating").alias("stars"), C("review_text").alias("text"),
        F.date_format("date", STAMP).alias("date"), (rid % 5).cast("int").alias("useful"),
        (rid % 3).cast("int").alias("funny"), (rid % 2).cast("int").alias("cool"))


LANDED_SQL = """landed AS (SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(user_id AS VARCHAR) AS user_id,
product_id AS business_id, rating AS stars, review_text AS text, strftime(date, '%Y-%m-%d %H:%M:%S') AS date,
CAST(review_id % 5 AS INTEGER) AS useful, CAST(review_id % 3 AS INTEGER) AS funny, CAST(review_id % 2 AS INTEGER) AS cool,
review_id AS n FROM reviews_v)"""
CONFORMED_SQL = """review_id, user_id, business_id AS product_id, stars AS rating, text AS review_text, date,
useful AS useful_votes, funny AS funny_votes, cool AS cool_votes, 'yelp_open_dataset' AS source"""


def land_json_lines(t, folder=None):
    """JSON lines with every 17th line cut short."""
    path = folder or scratch_path(t.spark, "landed-review")
    js = F.to_json(F.struct("*"))
    broken = F.col("review_id").cast("bigint") % 17 == 0
    landed_reviews(t).select(F.when(broken, F.substring(js, 1, 20)).otherwise(js).alias("value")).write.text(path)
    return path


@query("ingest_jsonl", with_views("SELECT review_id, stars, text, useful FROM landed WHERE n % 17 <> 0", reviews=True,
                                  extra=LANDED_SQL))
def ingest_jsonl(t):
    rows = R.json_lines(t.spark, land_json_lines(t), S.REVIEW_DDL)
    return R.require_rows(rows).select("review_id", "stars", "text", "useful")


@query("ingest_by_type", with_views("""
SELECT 'review' AS kind, 'completed' AS status, count(*) FILTER (WHERE n % 17 <> 0) AS rows,
       count(*) FILTER (WHERE n % 17 = 0) AS bad_lines FROM landed
UNION ALL SELECT 'business', 'completed', count(*), 0 FROM part
UNION ALL SELECT 'user', 'completed', count(*), 0 FROM customer""", reviews=True, extra=LANDED_SQL))
def ingest_by_type(t):
    return _collected(t).select("kind", "status", "rows", "bad_lines")


def _collected(t, kinds=("review", "business", "user")):
    folder = scratch_path(t.spark, "landing")
    js = F.to_json(F.struct("*"))
    land_json_lines(t, f"{folder}/review")
    businesses(t).select(js.alias("value")).write.text(f"{folder}/business")
    users(t).select(js.alias("value")).write.text(f"{folder}/user")
    entities = {k: R.Entity("*", e.ddl, e.transform) for k, e in R.ENTITIES.items()}
    return R.collect_entities(t.spark, folder, scratch_path(t.spark, "collected"), kinds, entities)


@query("ingest_report", with_views("""
SELECT 'review' AS kind, 'completed' AS status, count(*) FILTER (WHERE n % 17 <> 0) AS rows, '' AS error FROM landed
UNION ALL SELECT 'business', 'completed', count(*), '' FROM part
UNION ALL SELECT 'user', 'completed', count(*), '' FROM customer
UNION ALL SELECT 'tip', 'failed', 0, 'KeyError'""", reviews=True, extra=LANDED_SQL))
def ingest_report(t):
    out = _collected(t, ("review", "business", "user", "tip"))
    return out.select("kind", "status", "rows", F.coalesce("error", F.lit("")).alias("error"))


SHOP_SELECT = """CAST(review_id AS VARCHAR) AS review_id, product_id, CAST(user_id AS VARCHAR) AS user_id, rating,
review_text, epoch_us(date) // 1000000 AS timestamp"""


def shop_rows(t, modern):
    names = ("asin", "reviewerID", "overall", "reviewText", "unixReviewTime") if modern else (
        "ProductId", "UserId", "Score", "Text", "Time")
    kinds = (C("product_id"), C("user_id").cast("string"), C("rating"), C("review_text"), F.unix_seconds("date"))
    return t.reviews().select(C("review_id").cast("string").alias("Id"), *[c.alias(n) for c, n in zip(kinds, names)])


@query("ingest_csv", with_views(f"SELECT {SHOP_SELECT} FROM reviews_v", reviews=True))
def ingest_csv(t):
    path = O.csv(shop_rows(t, False), scratch_path(t.spark, "shop-csv"))
    rows = R.csv(t.spark, path, "Id STRING, ProductId STRING, UserId STRING, Score DOUBLE, Text STRING, Time BIGINT", multi_line=True)
    return N.shop_reviews(rows).select("review_id", "product_id", "user_id", "rating", "review_text", "timestamp")


@query("ingest_json_lines_alt", with_views(f"SELECT {SHOP_SELECT} FROM reviews_v", reviews=True))
def ingest_json_lines_alt(t):
    path = O.json(shop_rows(t, True), scratch_path(t.spark, "shop-json"))
    ddl = "Id STRING, asin STRING, reviewerID STRING, overall DOUBLE, reviewText STRING, unixReviewTime BIGINT"
    rows = R.good(R.json_lines(t.spark, path, ddl))
    return N.shop_reviews(rows).select("review_id", "product_id", "user_id", "rating", "review_text", "timestamp")


@query("ingest_select_files", with_views(
    "SELECT review_id, business_id FROM landed WHERE business_id IN ('src1', 'src7', 'src13')", reviews=True,
    extra=LANDED_SQL))
def ingest_select_files(t):
    path = scratch_path(t.spark, "by-source")
    landed_reviews(t).withColumn("part", C("business_id")).write.partitionBy("part").json(path)
    rows = R.named_files(t.spark, path, [f"part=src{i}" for i in (1, 7, 13)], S.REVIEW_DDL)
    return rows.select("review_id", "business_id")


@query("write_parquet", with_views("SELECT review_id, business_id, stars FROM landed", reviews=True, extra=LANDED_SQL))
def write_parquet(t):
    path = O.parquet(landed_reviews(t), scratch_path(t.spark, "out"), partition_by=["business_id"])
    return R.parquet(t.spark, path).select("review_id", "business_id", "stars")


@query("read_parquet", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_quantity > 40""")
def read_parquet(t):
    rows = R.parquet(t.spark, f"{t.root}/lineitem.parquet")
    late = C("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")
    return rows.where(late & (C("l_quantity") > 40)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("union_sources", with_views("""
SELECT 'reviews' AS source, review_id AS item_id, rating, NULL AS role FROM reviews_v
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, NULL, role FROM conversations""", reviews=True))
def union_sources(t):
    talk = t.base("conversations").select((C("conv_id") * 1000 + C("turn")).alias("item_id"), "role")
    rows = t.reviews().select(C("review_id").alias("item_id"), "rating")
    return N.union_sources({"reviews": rows, "conversations": talk})


@query("concat_chunks", """
SELECT event_id, value, NULL AS props FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, NULL, props FROM events WHERE event_type <> 'click'
UNION ALL SELECT event_id, value, props FROM events""")
def concat_chunks(t):
    e = t.base("events")
    return N.concat([e.where("event_type = 'click'").select("event_id", "value"),
                     e.where("event_type <> 'click'").select("event_id", "props"), e.select("event_id", "value", "props")])


@query("write_csv", with_views("SELECT review_id, text, stars FROM landed", reviews=True, extra=LANDED_SQL))
def write_csv(t):
    path = O.csv(landed_reviews(t).select("review_id", "text", "stars"), scratch_path(t.spark, "out-csv"))
    return R.csv(t.spark, path, "review_id STRING, text STRING, stars DOUBLE", multi_line=True)


@query("write_json", with_views("SELECT review_id, text, stars FROM landed", reviews=True, extra=LANDED_SQL))
def write_json(t):
    path = O.json(landed_reviews(t).select("review_id", "text", "stars"), scratch_path(t.spark, "out-json"))
    return R.good(R.json_lines(t.spark, path, "review_id STRING, text STRING, stars DOUBLE"))


@query("read_json_docs", """SELECT n_regionkey AS region, count(*) AS nations FROM nation GROUP BY 1""")
def read_json_docs(t):
    path = scratch_path(t.spark, "documents")
    doc = t.base("nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    pretty = F.to_json(F.struct(C("n_regionkey").alias("region"), "nations"), {"pretty": "true"})
    doc.select(pretty.alias("value"), C("n_regionkey").alias("part")).repartition("part").write.partitionBy("part").text(path)
    return R.json_documents(t.spark, path, "region INT, nations BIGINT").select("region", "nations")


def nested(t):
    """API pages: the reviews of one business and one hundred consecutive ids per document."""
    item = F.struct(
        C("review_id").cast("string").alias("id"),
        F.struct(C("user_id").cast("string").alias("id"), F.concat(F.lit("user "), C("user_id").cast("string")).alias("name"))
        .alias("user"), "rating", C("review_text").alias("text"), F.date_format("date", STAMP).alias("time_created"),
        F.concat(F.lit("http://x/"), C("review_id").cast("string")).alias("url"))
    return t.reviews().groupBy(C("product_id").alias("business_id"), F.expr("review_id div 100").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("review_id", item.alias("r")))).alias("sorted")).select(
        "business_id", "page", F.transform("sorted", lambda s: s["r"]).alias("reviews"))


NESTED_SQL = """ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY review_id) AS BIGINT) AS position
FROM reviews_v)"""


@query("flatten_nested_reviews", with_views("""
SELECT product_id, position, CAST(review_id AS VARCHAR) AS review_id, CAST(user_id AS VARCHAR) AS user_id,
 'user ' || user_id AS user_name, rating, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, 'http://x/' || review_id AS url
FROM ranked WHERE position <= 20""", reviews=True, extra=NESTED_SQL))
def flatten_nested_reviews(t):
    path = O.json(nested(t), scratch_path(t.spark, "nested"))
    ddl = """business_id STRING, page BIGINT, reviews ARRAY<STRUCT<id: STRING, user: STRUCT<id: STRING, name: STRING>,
             rating: DOUBLE, text: STRING, time_created: STRING, url: STRING>>"""
    return N.flatten_nested(R.good(R.json_lines(t.spark, path, ddl)), 20).select(
        "product_id", C("position").cast("bigint").alias("position"), "review_id", "user_id", "user_name", "rating",
        "date", "url")


@query("first_n_reviews", with_views(
    "SELECT product_id, review_id FROM ranked WHERE position <= 5", reviews=True, extra=NESTED_SQL))
def first_n_reviews(t):
    from trustloom.operators.ranking import first_rows

    return first_rows(t.reviews().select("product_id", "review_id"), ["product_id"], [C("review_id")], 5).select(
        "product_id", "review_id")


@query("ingest_labelled_lines", with_views("""
SELECT md5(line) AS text_key, is_fake, sentiment, CAST(CASE sentiment WHEN 'positive' THEN 5 ELSE 1 END AS DOUBLE) AS rating
FROM (SELECT trim(unnest(string_split(replace(replace(review_text, chr(13), chr(10)), chr(12), chr(10)), chr(10)))) AS line,
 review_id % 2 = 0 AS is_fake, CASE WHEN review_id % 4 < 2 THEN 'positive' ELSE 'negative' END AS sentiment
 FROM reviews_v) WHERE length(line) > 0""", reviews=True))
def ingest_labelled_lines(t):
    path = scratch_path(t.spark, "lines")
    rid = C("review_id")
    name = F.concat(F.when(rid % 2 == 0, "deceptive").otherwise("truthful"), F.lit("_"),
                    F.when(rid % 4 < 2, "positive").otherwise("negative"))
    lines = t.reviews().select(F.translate("review_text", "\r\f", "\n\n").alias("value"), name.alias("name"))
    for label in ("deceptive_positive", "deceptive_negative", "truthful_positive", "truthful_negative"):
        lines.where(C("name") == label).select("value").write.text(f"{path}/{label}")
    out = R.labelled_lines(t.spark, f"{path}/*")
    return out.select(F.md5("text").alias("text_key"), "is_fake", "sentiment", "rating")


def businesses(t):
    return t.base("part").select(
        C("p_partkey").cast("string").alias("business_id"), C("p_name").alias("name"), C("p_brand").alias("city"),
        C("p_type").alias("state"), C("p_retailprice").alias("stars"), C("p_size").cast("bigint").alias("review_count"))


def users(t):
    return t.base("customer").select(
        C("c_custkey").cast("string").alias("user_id"), C("c_name").alias("name"),
        C("c_nationkey").cast("bigint").alias("review_count"), C("c_acctbal").alias("average_stars"),
        C("c_mktsegment").alias("segment"))


@query("conform_yelp_reviews", with_views(f"SELECT {CONFORMED_SQL} FROM landed", reviews=True, extra=LANDED_SQL))
def conform_yelp_reviews(t):
    return N.reviews(landed_reviews(t)).drop("collected_at")


@query("conform_businesses", """
SELECT CAST(p_partkey AS VARCHAR) AS business_id, p_name AS name, p_brand AS city, p_type AS state, p_retailprice AS stars,
       CAST(p_size AS BIGINT) AS review_count, 'yelp_open_dataset' AS source FROM part""")
def conform_businesses(t):
    return N.businesses(businesses(t)).drop("collected_at")


@query("conform_users", """
SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS review_count,
       c_acctbal AS average_stars, 'yelp_open_dataset' AS source FROM customer""")
def conform_users(t):
    return N.users(users(t)).drop("collected_at")


@query("conform_amazon_reviews", with_views(f"""
SELECT {SHOP_SELECT}, 'amazon_kaggle' AS source, epoch_us(date) // 1000000 * 1000000 AS date_micros FROM reviews_v
UNION ALL SELECT {SHOP_SELECT}, 'amazon_kaggle', epoch_us(date) // 1000000 * 1000000 FROM reviews_v""", reviews=True))
def conform_amazon_reviews(t):
    both = N.concat([shop_rows(t, False), shop_rows(t, True)])
    return N.shop_reviews(both).select("review_id", "product_id", "user_id", "rating", "review_text", "timestamp",
                                       "source", F.unix_micros("date").alias("date_micros"))


ITEMS_SQL = """items AS (SELECT review_text AS text, 'review_site' AS platform, 'review' AS content_type,
 CASE WHEN review_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id, rating, date AS timestamp, product_id,
 is_fake = 1 AS is_fake, review_id FROM reviews_v)"""
ID_SQL = """'review_site_' || left(md5(text || '_' || coalesce(user_id, 'None') || '_' ||
 coalesce(strftime(timestamp, '%Y-%m-%d %H:%M:%S'), 'None')), 12)"""


def items(t):
    return t.reviews().select(
        C("review_text").alias("text"), F.lit("review_site").alias("platform"), F.lit("review").alias("content_type"),
        F.when(C("review_id") % 5 != 0, C("user_id").cast("string")).alias("user_id"), "rating",
        F.date_trunc("SECOND", "date").alias("timestamp"), "product_id", (C("is_fake") == 1).alias("is_fake"),
        F.create_map(F.lit("lang"), C("lang")).alias("metadata"), "review_id")


@query("conform_content_items", with_views(f"""
SELECT {ID_SQL} AS content_id, platform, content_type, user_id, rating, product_id, NULL::VARCHAR AS business_id, coalesce(CAST(is_fake AS VARCHAR), 'unknown') AS is_fake,
       CAST(length(text) AS BIGINT) AS n FROM items""", reviews=True, extra=ITEMS_SQL))
def conform_content_items(t):
    out = N.content_items(items(t), t.now())
    return out.select(C("metadata")["content_id"].alias("content_id"), "platform", "content_type", "user_id", "rating",
                      "product_id", "business_id", F.coalesce(C("is_fake").cast("string"), F.lit("unknown")).alias("is_fake"),
                      F.length("text").cast("bigint").alias("n"))


@query("content_id", with_views(f"SELECT review_id, {ID_SQL} AS content_id FROM items", reviews=True, extra=ITEMS_SQL))
def content_id(t):
    return items(t).select("review_id", N.content_id(C("platform"), C("text"), C("user_id"), C("timestamp"))
                           .alias("content_id"))


@query("prepare_request_rows", f"""
SELECT event_id AS request_id, event_type AS text, event_type AS review_text, CAST(user_id AS VARCHAR) AS user_id,
 CASE WHEN event_id % 7 = 0 THEN -1 WHEN event_id % 5 = 0 THEN epoch_us(TIMESTAMP '{NOW}')
      ELSE epoch_us(ts) // 1000000 * 1000000 END AS date_micros, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events""")
def prepare_request_rows(t):
    eid = C("event_id")
    rows = t.events().select(
        eid.alias("request_id"), C("event_type").alias("text"), C("user_id").cast("string").alias("user_id"),
        F.when(eid % 7 == 0, None).when(eid % 5 == 0, "not a time").otherwise(F.date_format("ts", STAMP)).alias("timestamp"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("text"), F.lit("no")).alias("extra"))
    out = N.request_rows(rows, t.now())
    return out.select("request_id", "text", "review_text", "user_id",
                      F.coalesce(F.unix_micros("date"), F.lit(-1)).alias("date_micros"), C("extra")["k"].alias("k"))


@query("batch_zip", """
WITH b AS (SELECT conv_id * 1000 + turn AS batch_id, string_split(text, ' ') AS texts FROM conversations),
x AS (SELECT batch_id, unnest(texts) AS text, unnest(range(0, len(texts))) AS pos, len(texts) AS n FROM b)
SELECT batch_id, CAST(pos AS BIGINT) AS pos, text, CASE WHEN pos < n - 1 THEN 'u-' || text END AS user_id,
 CASE WHEN pos < 2 THEN CAST(pos + 1 AS DOUBLE) END AS rating FROM x""")
def batch_zip(t):
    texts = F.split("text", " ")
    batches = t.base("conversations").select(
        (C("conv_id") * 1000 + C("turn")).alias("batch_id"), texts.alias("texts"),
        F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda w: F.concat(F.lit("u-"), w)).alias("user_ids"),
        F.array(F.lit(1.0), F.lit(2.0)).alias("ratings"))
    out = N.zip_batches(batches, "batch_id", ["texts", "user_ids", "ratings"])
    return out.select("batch_id", C("pos").cast("bigint").alias("pos"), C("texts").alias("text"),
                      C("user_ids").alias("user_id"), C("ratings").alias("rating"))


@query("select_numeric", """SELECT event_id, user_id, value FROM events""")
def select_numeric(t):
    e = t.base("events")
    return e.select(*N.numeric_columns(e))


@query("build_payload", with_views("""
SELECT request_id, '{"user_profile":{"user_id":"' || user_id || '"' ||
 CASE WHEN account_age_days IS NOT NULL THEN ',"account_age_days":' || account_age_days ELSE '' END || ',"total_reviews":' ||
 total_reviews || '},"product_id":"' || item_id || '"' || CASE WHEN rating IS NOT NULL THEN ',"rating":' ||
 CAST(CAST(rating AS INTEGER) AS VARCHAR) ELSE '' END || '}' AS payload FROM requests""", scored=True, extra=REQUESTS_SQL))
def build_payload(t):
    profile = F.struct("user_id", "account_age_days", "total_reviews")
    payload = N.context_payload({"user_profile": profile, "product_id": C("item_id"), "rating": C("rating").cast("int")})
    return requests(t).select("request_id", payload.alias("payload"))


@query("enrich_review_context", """
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, p.p_name AS business_name, p.p_brand AS business_brand
FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey""")
def enrich_review_context(t):
    li = t.base("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", C("l_partkey").alias("product_id"))
    parts = t.base("part").select(C("p_partkey").alias("product_id"), C("p_name").alias("business_name"),
                                  C("p_brand").alias("business_brand"))
    return li.join(parts, "product_id", "left").drop("product_id")


@query("publish_metric_rows", """
SELECT event_type AS name, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY event_type""")
def publish_metric_rows(t):
    path = scratch_path(t.spark, "metrics")
    rows = t.events().select("ts", C("event_type").alias("name"), F.create_map(F.lit("user"), C("user_id").cast("string"))
                             .alias("labels"), F.lit("counter").alias("kind"), "value")
    O.append_metric_rows(rows, path)
    return t.spark.read.parquet(path).groupBy("name").agg(
        F.count("*").alias("n"), (F.floor(F.sum("value") * 100 + 0.5) / 100).alias("total"))


@query("save_load_baseline", with_views("""
SELECT platform, count(*) AS n, max(epoch_us(ts)) AS checked FROM scored_v GROUP BY platform""", scored=True))
def save_load_baseline(t):
    from trustloom.sources import models as M

    path = scratch_path(t.spark, "baseline")
    state = t.scored().groupBy("platform").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    M.append_state(state.withColumns({"n": C("n") - 1, "ts": C("ts") - F.expr("INTERVAL 1 DAY")}), path)
    M.append_state(state, path)
    return M.latest_state(t.spark, path, ["platform"], "ts").select("platform", "n", F.unix_micros("ts").alias("checked"))
