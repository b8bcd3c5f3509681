"""Statistics, evaluation and monitoring aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import risk as R, text as X
from trustloom.operators import behaviour as B, drift as D, evaluation as E, features as FE, moderation as P, monitoring as M, sketches as SK
from trustloom.operators import ranking as K
from trustloom.plans.joins import stats_sql
from trustloom.plans.registry import query
from trustloom.plans.scalars import AUTH_SQL, level_sql
from trustloom.plans.text import CLEANED_CTE
from trustloom.plans.views import NOW, r6, round6, with_views
from trustloom.plans.windows import ANOMALY_SQL, BASELINE_SQL, GAPS_SQL

C = F.col
STAT_COLS = ("rating_mean", "rating_std", "length_mean", "length_std")


def rounded(df, cols):
    return df.withColumns({c: round6(c) for c in cols})


def key_stats_sql(key):
    return with_views(f"SELECT {key}, rating_count, " + ", ".join(f"{r6(c)} AS {c}" for c in STAT_COLS) + " FROM s",
                      reviews=True, extra=f"s AS ({stats_sql(key)})")


@query("user_stats", key_stats_sql("user_id"))
def user_stats(t):
    return rounded(B.key_stats(t.reviews(), "user_id"), STAT_COLS)


@query("product_stats", key_stats_sql("product_id"))
def product_stats(t):
    return rounded(B.key_stats(t.reviews(), "product_id"), STAT_COLS)


def behaviour_sql(key, distinct, out):
    return with_views(f"""SELECT {key}, count(*) AS text_count, {r6('avg(rating)')} AS rating_mean,
 {r6('coalesce(stddev_samp(rating), 0.0)')} AS rating_std, count(DISTINCT {distinct}) AS {out} FROM purchases_v GROUP BY {key}""",
                      purchases=True)


def behaviour(t, key, distinct, out):
    rows = t.purchases().withColumn("review_text", F.lit("x"))
    return rounded(B.behaviour_stats(rows, key, distinct, out), ("rating_mean", "rating_std"))


@query("user_behaviour", behaviour_sql("user_id", "date", "distinct_dates"))
def user_behaviour(t):
    return behaviour(t, "user_id", "date", "distinct_dates")


@query("product_behaviour", behaviour_sql("product_id", "user_id", "distinct_users"))
def product_behaviour(t):
    return behaviour(t, "product_id", "user_id", "distinct_users")


R4 = "floor(({}) * 1e4 + 0.5) / 1e4"


@query("user_profile_stats", with_views(f"""
SELECT *, rating_max - rating_min AS rating_range, CAST(floor((last_us - first_us) / 86400000000.0) AS BIGINT) AS account_age_days,
 {r6('rating_count / (floor((last_us - first_us) / 86400000000.0) + 1)')} AS reviews_per_day FROM (
SELECT user_id, count(rating) AS rating_count, {R4.format('avg(rating)')} AS rating_mean,
 {R4.format('coalesce(stddev_samp(rating), 0.0)')} AS rating_std, min(rating) AS rating_min, max(rating) AS rating_max,
 {R4.format('avg(length(review_text))')} AS review_length_mean,
 {R4.format('coalesce(stddev_samp(length(review_text)), 0.0)')} AS review_length_std, min(epoch_us(date)) AS first_us,
 max(epoch_us(date)) AS last_us, {R4.format('avg(CASE WHEN review_id % 3 = 0 THEN 1 ELSE 0 END)')} AS verified_rate,
 CAST(sum(review_id % 7) AS BIGINT) AS helpful_sum, {R4.format('avg(review_id % 7)')} AS helpful_mean
FROM reviews_v GROUP BY user_id)""", reviews=True))
def user_profile_stats(t):
    rows = t.reviews().withColumns({"verified_purchase": C("review_id") % 3 == 0, "helpful_votes": C("review_id") % 7})
    out = B.user_profile(rows).withColumns({"first_us": F.unix_micros("first_review"), "last_us": F.unix_micros("last_review")})
    return rounded(out.drop("first_review", "last_review"), ("reviews_per_day",))


@query("user_temporal_stats", with_views(f"""
SELECT user_id, {r6('coalesce(a, 0)')} AS avg_time_between_reviews, {r6('coalesce(s, 0)')} AS std_time_between_reviews,
 {r6('coalesce(m, 0)')} AS min_time_between_reviews, reviews_in_1_hour, reviews_in_24_hours, most_active_hour, hour_diversity
FROM g JOIN h USING (user_id)""", reviews=True, extra=f"""{GAPS_SQL},
g AS (SELECT user_id, avg(gap_hours) AS a, stddev_samp(gap_hours) AS s, min(gap_hours) AS m,
 count(*) FILTER (WHERE gap_hours < 1) AS reviews_in_1_hour, count(*) FILTER (WHERE gap_hours < 24) AS reviews_in_24_hours
 FROM gaps GROUP BY user_id),
hh AS (SELECT user_id, hour(date) AS h, count(*) AS n FROM reviews_v GROUP BY 1, 2),
h AS (SELECT user_id, count(*) AS hour_diversity, min(h) FILTER (WHERE k = 1) AS most_active_hour FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) AS k FROM hh) GROUP BY user_id)"""))
def user_temporal_stats(t):
    out = rounded(B.user_temporal(t.reviews()), ("avg_time_between_reviews", "std_time_between_reviews",
                                                 "min_time_between_reviews"))
    return out.withColumn("most_active_hour", C("most_active_hour").cast("bigint"))


@query("preprocessing_stats", with_views(f"""
SELECT count(*) AS total_records, {r6('avg(length(review_text))')} AS original_mean, {r6('median(length(review_text))')} AS
 original_median, count(*) FILTER (WHERE review_text = '') AS original_empty, {r6('avg(length(cleaned_text))')} AS cleaned_mean,
 {r6('median(length(cleaned_text))')} AS cleaned_median, count(*) FILTER (WHERE cleaned_text = '') AS cleaned_empty,
 {r6('1 - avg(length(cleaned_text)) / (avg(length(review_text)) + 1)')} AS reduction_ratio, count(kind) AS total_anomalies,
 {r6('count(kind) / count(*)')} AS anomaly_rate FROM cleaned JOIN flagged USING (review_id)""".replace(
    "length(review_text)", "length(cleaned.review_text)").replace("review_text = ''", "cleaned.review_text = ''"),
    reviews=True, extra=f"{CLEANED_CTE}, {GAPS_SQL}, {ANOMALY_SQL}"))
def preprocessing_stats(t):
    text = C("review_text")
    narrow = t.reviews().select("review_id", "user_id", "date", X.text_length(text).alias("a"),
                                X.text_length(X.clean(text)).alias("b"))
    flagged = B.with_temporal_anomaly(narrow, t.now())
    out = flagged.agg(
        F.count("*").alias("total_records"), F.avg("a").alias("original_mean"), F.median("a").alias("original_median"),
        F.count(F.when(C("a") == 0, 1)).alias("original_empty"), F.avg("b").alias("cleaned_mean"),
        F.median("b").alias("cleaned_median"), F.count(F.when(C("b") == 0, 1)).alias("cleaned_empty"),
        (1 - F.avg("b") / (F.avg("a") + 1)).alias("reduction_ratio"),
        F.count(F.when(C("temporal_anomaly"), 1)).alias("total_anomalies"),
        F.avg(C("temporal_anomaly").cast("int")).alias("anomaly_rate"))
    return rounded(out, ("original_mean", "original_median", "cleaned_mean", "cleaned_median", "reduction_ratio",
                         "anomaly_rate"))


ITEMS_SQL = """items AS (SELECT 'review_site' AS platform, 'review' AS content_type, is_fake, length(review_text) AS n FROM
 reviews_v UNION ALL SELECT 'forum', CASE WHEN turn = 0 THEN 'post' ELSE 'reply' END, NULL, length(text) FROM conversations)"""


def items(t):
    r = t.reviews().select(F.lit("review_site").alias("platform"), F.lit("review").alias("content_type"), "is_fake",
                           F.length("review_text").alias("n"))
    c = t.base("conversations").select(F.lit("forum").alias("platform"), F.when(C("turn") == 0, "post").otherwise("reply")
                                       .alias("content_type"), F.lit(None).cast("int").alias("is_fake"),
                                       F.length("text").alias("n"))
    return r.unionByName(c)


@query("collection_stats", with_views(f"""
SELECT cut, value, items, {r6('100.0 * labelled / items')} AS labelled_percent, {r6('mean_length')} AS mean_length FROM (
SELECT CASE WHEN grouping(platform) = 0 THEN 'platform' WHEN grouping(content_type) = 0 THEN 'content_type'
 WHEN grouping(label) = 0 THEN 'label' ELSE 'total' END AS cut, coalesce(platform, content_type, label, 'all') AS value,
 count(*) AS items, count(is_fake) AS labelled, avg(n) AS mean_length FROM (SELECT *, CASE is_fake WHEN 1 THEN 'fake' WHEN 0
 THEN 'authentic' END AS label FROM items) GROUP BY GROUPING SETS ((platform), (content_type), (label), ())
 HAVING NOT (grouping(label) = 0 AND label IS NULL))""", reviews=True, extra=ITEMS_SQL))
def collection_stats(t):
    return rounded(M.collection_stats(items(t)), ("labelled_percent", "mean_length"))


@query("class_distribution", with_views(f"""
SELECT part, is_fake, count(*) AS rows, {r6('count(*) / sum(count(*)) OVER (PARTITION BY part)')} AS share
FROM (SELECT CASE WHEN review_id % 5 = 0 THEN 'test' ELSE 'train' END AS part, is_fake FROM reviews_v WHERE is_fake IS NOT NULL)
GROUP BY part, is_fake""", reviews=True))
def class_distribution(t):
    rows = t.reviews().where("is_fake IS NOT NULL").select(
        F.when(C("review_id") % 5 == 0, "test").otherwise("train").alias("part"), "is_fake")
    return rounded(E.class_distribution(rows, "is_fake", ["part"]), ("share",))


PRED_CLASS_SQL = """multi AS (SELECT *, CASE WHEN prediction_id % 3 = 0 THEN 'view' WHEN prediction_id % 7 = 0 THEN 'click'
 ELSE class_label END AS pred_class FROM scored_v)"""


def multi(t):
    pid = C("prediction_id")
    return t.scored().withColumn("pred_class", F.when(pid % 3 == 0, "view").when(pid % 7 == 0, "click")
                                 .otherwise(C("class_label")))


@query("confusion_matrix", with_views(f"""
SELECT actual, predicted, n AS rows, {r6('CASE WHEN a > 0 THEN n / a ELSE 0.0 END')} AS by_true,
 {r6('CASE WHEN b > 0 THEN n / b ELSE 0.0 END')} AS by_pred, {r6('n / t')} AS of_all
FROM (SELECT *, sum(n) OVER (PARTITION BY actual) AS a, sum(n) OVER (PARTITION BY predicted) AS b, sum(n) OVER () AS t FROM (
 SELECT x.c AS actual, y.c AS predicted, count(m.prediction_id) AS n FROM classes x CROSS JOIN classes y LEFT JOIN multi m ON
 m.class_label = x.c AND m.pred_class = y.c GROUP BY 1, 2))""", scored=True, extra=f"""{PRED_CLASS_SQL},
classes AS (SELECT DISTINCT class_label AS c FROM multi UNION SELECT DISTINCT pred_class FROM multi)"""))
def confusion_matrix(t):
    return rounded(E.confusion_matrix(multi(t), [], "class_label", "pred_class"), ("by_true", "by_pred", "of_all"))


CELLS_SQL = """cells AS (SELECT platform, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y_true * y_pred) AS DOUBLE) AS tp,
 CAST(sum((1 - y_true) * y_pred) AS DOUBLE) AS fp, CAST(sum(y_true * (1 - y_pred)) AS DOUBLE) AS fn,
 CAST(sum((1 - y_true) * (1 - y_pred)) AS DOUBLE) AS tn FROM scored_v GROUP BY platform)"""


@query("classification_metrics", with_views(f"""
SELECT platform, CAST(n AS BIGINT) AS rows, {r6('(tp + tn) / n')} AS accuracy,
 {r6('(tp / (tp + fp) * (tp + fn) + tn / (tn + fn) * (tn + fp)) / n')} AS precision, {r6('(tp + tn) / n')} AS recall,
 {r6('(2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / n')} AS f1_score,
 {r6('tn / (tn + fp)')} AS specificity, {r6('(tp + tn) / n')} AS sensitivity, {r6('tp / (tp + fn)')} AS tpr,
 {r6('(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc FROM cells""", scored=True,
                                            extra=CELLS_SQL))
def classification_metrics(t):
    out = E.classification_metrics(t.scored(), ["platform"], "y_true", "y_pred")
    return rounded(out, ("accuracy", "precision", "recall", "f1_score", "specificity", "sensitivity", "tpr", "mcc"))


@query("cohen_kappa", with_views(f"""
SELECT platform, {r6('((tp + tn) / n - e) / (1 - e)')} AS kappa FROM (SELECT *, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn))
 / (n * n) AS e FROM cells)""", scored=True, extra=CELLS_SQL))
def cohen_kappa(t):
    return rounded(E.cohen_kappa(t.scored(), ["platform"], "y_true", "y_pred"), ("kappa",))


@query("classification_report", with_views(f"""
SELECT label, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1_score')} AS f1_score, support FROM (
SELECT label, precision, recall, f1_score, support FROM rates UNION ALL
SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM rates
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM rates
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
 sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM rates)""", scored=True, extra=f"""{PRED_CLASS_SQL},
t AS (SELECT class_label AS label, count(*) AS support, count(*) FILTER (WHERE pred_class = class_label) AS tp FROM multi GROUP
 BY 1), q AS (SELECT pred_class AS label, count(*) AS predicted FROM multi GROUP BY 1),
rates AS (SELECT label, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, tp / support AS recall,
 2 * tp / (support + coalesce(predicted, 0)) AS f1_score FROM t LEFT JOIN q USING (label))"""))
def classification_report(t):
    return rounded(E.classification_report(multi(t), [], "class_label", "pred_class"), ("precision", "recall", "f1_score"))


CURVE_SQL = """pts AS (SELECT platform, p_fake AS threshold, CAST(sum(y_true) AS DOUBLE) AS pos,
 CAST(sum(1 - y_true) AS DOUBLE) AS neg FROM scored_v GROUP BY 1, 2),
curve AS (SELECT *, sum(pos) OVER w AS rp, sum(neg) OVER w AS rn, sum(pos) OVER (PARTITION BY platform) AS ap,
 sum(neg) OVER (PARTITION BY platform) AS an FROM pts WINDOW w AS (PARTITION BY platform ORDER BY threshold DESC
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
IS_FAKE = lambda: C("y_true") == 1


@query("roc_curve", with_views(f"SELECT platform, threshold, {r6('rn / an')} AS fpr, {r6('rp / ap')} AS tpr FROM curve",
                               scored=True, extra=CURVE_SQL))
def roc_curve(t):
    return rounded(E.roc_curve(t.scored(), ["platform"], IS_FAKE(), "p_fake"), ("fpr", "tpr"))


@query("pr_curve", with_views(
    f"SELECT platform, threshold, {r6('rp / (rp + rn)')} AS precision, {r6('rp / ap')} AS recall FROM curve", scored=True,
    extra=CURVE_SQL))
def pr_curve(t):
    return rounded(E.pr_curve(t.scored(), ["platform"], IS_FAKE(), "p_fake"), ("precision", "recall"))


@query("roc_auc", with_views(f"""
SELECT platform, CAST(max(ap) AS BIGINT) AS positives, {r6('sum(neg * (rp - pos / 2)) / (max(ap) * max(an))')} AS roc_auc
FROM curve GROUP BY platform""", scored=True, extra=CURVE_SQL))
def roc_auc(t):
    return rounded(E.roc_auc(t.scored(), ["platform"], IS_FAKE(), "p_fake"), ("roc_auc",))


@query("pr_auc", with_views(f"SELECT platform, {r6('sum(pos * rp / (rp + rn)) / max(ap)')} AS pr_auc FROM curve GROUP BY platform",
                            scored=True, extra=CURVE_SQL))
def pr_auc(t):
    return rounded(E.pr_auc(t.scored(), ["platform"], IS_FAKE(), "p_fake"), ("pr_auc",))


CLASSES = ("click", "error", "purchase", "signup", "view")


@query("roc_auc_ovr", with_views(f"""
SELECT {r6('sum(auc * p) / sum(p)')} AS roc_auc FROM (SELECT class, max(ap) AS p, sum(neg * (rp - pos / 2)) / (max(ap) * max(an))
 AS auc FROM c GROUP BY class)""", scored=True, extra=f"""
long AS (SELECT s.class_label = k.class AS hit, k.class, CAST((s.prediction_id * 7919 + k.i * 101 + CASE WHEN s.class_label =
 k.class THEN 300 ELSE 0 END) % 1000 AS DOUBLE) / 1000 AS score FROM scored_v s CROSS JOIN (VALUES
 {', '.join(f"('{c}', {i})" for i, c in enumerate(CLASSES))}) k(class, i)),
p AS (SELECT class, score, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE NOT hit) AS DOUBLE)
 AS neg FROM long GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS rp, sum(pos) OVER (PARTITION BY class) AS ap, sum(neg) OVER (PARTITION BY class) AS an FROM p
 WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""".strip()))
def roc_auc_ovr(t):
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(i).alias("i")) for i, c in enumerate(CLASSES)])
    long = t.scored().select("prediction_id", "class_label", F.explode(pairs).alias("k")).select(
        "prediction_id", "class_label", "k.class", "k.i")
    hit = C("class_label") == C("class")
    score = (C("prediction_id") * 7919 + C("i") * 101 + F.when(hit, 300).otherwise(0)) % 1000
    return rounded(E.roc_auc_ovr(long.withColumn("score", score.cast("double") / 1000), [], "class", hit, "score"), ("roc_auc",))


def scored_levels(t):
    score = R.authenticity(C("p_fake"))
    return t.scored().withColumns({"authenticity_score": score, "risk_level": R.risk_level(score)})


LEVELS_SQL = f"levels AS (SELECT *, {AUTH_SQL} AS score, {level_sql(AUTH_SQL)} AS risk_level FROM scored_v)"
RISKY = "risk_level IN ('high', 'critical')"


@query("analytics_summary", with_views(f"""
SELECT CASE WHEN grouping(platform) = 0 THEN 'platform' WHEN grouping(risk_level) = 0 THEN 'risk_level' ELSE 'total' END AS cut,
 coalesce(platform, risk_level, 'all') AS value, count(*) AS analyses, count(*) FILTER (WHERE {RISKY}) AS risky,
 {r6('avg(score)')} AS avg_score, {r6('count(*) * 100 / (SELECT count(*) FROM levels)')} AS percent
FROM levels GROUP BY GROUPING SETS ((platform), (risk_level), ())""", scored=True, extra=LEVELS_SQL))
def analytics_summary(t):
    return rounded(P.analytics_summary(scored_levels(t)), ("avg_score", "percent"))


@query("hourly_trend", with_views(f"""
SELECT epoch_us(h) // 1000000 AS hour, count(l.prediction_id) AS analyses, count(*) FILTER (WHERE {RISKY}) AS risky
FROM (SELECT date_trunc('hour', TIMESTAMP '{NOW}') - INTERVAL 1 HOUR * i AS h FROM range(24) r(i)) s
LEFT JOIN levels l ON date_trunc('hour', l.ts) = s.h GROUP BY h""", scored=True, extra=LEVELS_SQL))
def hourly_trend(t):
    out = P.hourly_trend(scored_levels(t), "ts", t.now())
    return out.select(F.unix_seconds("hour").alias("hour"), "analyses", "risky")


@query("metric_summary", f"""
WITH m AS (SELECT ts, event_id, event_type AS name, '{{"band":"' || (user_id % 3) || '","kind":"x"}}' AS labels,
 CASE event_type WHEN 'view' THEN 'gauge' WHEN 'purchase' THEN 'histogram' ELSE 'counter' END AS kind, value FROM events)
SELECT name, labels, kind, count(*) AS n, {r6("CASE WHEN kind = 'gauge' THEN max_by(value, ts) ELSE sum(value) END")} AS value,
 {r6("CASE WHEN kind = 'histogram' THEN avg(value) ELSE -1.0 END")} AS mean,
 CASE WHEN kind = 'histogram' THEN min(value) ELSE -1.0 END AS least,
 CASE WHEN kind = 'histogram' THEN max(value) ELSE -1.0 END AS greatest FROM m GROUP BY name, labels, kind""")
def metric_summary(t):
    kind = F.when(C("event_type") == "view", "gauge").when(C("event_type") == "purchase", "histogram").otherwise("counter")
    samples = t.events().select(
        "ts", C("event_type").alias("name"), kind.alias("kind"), "value",
        F.create_map(F.lit("kind"), F.lit("x"), F.lit("band"), (C("user_id") % 3).cast("string")).alias("labels"))
    out = M.metric_summary(samples).fillna(-1.0, ["mean", "least", "greatest"])
    return rounded(out, ("value", "mean"))


@query("probability_histogram", with_views(
    "SELECT platform, CAST(i AS DOUBLE) / 10 AS le, count(*) FILTER (WHERE p_fake <= CAST(i AS DOUBLE) / 10) AS rows "
    "FROM scored_v CROSS JOIN range(11) r(i) GROUP BY 1, 2", scored=True))
def probability_histogram(t):
    return E.probability_histogram(t.scored(), "p_fake", ["platform"])


@query("class_weights", with_views(f"""
SELECT is_fake, count(*) AS rows, {r6('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} AS weight FROM reviews_v
WHERE is_fake IS NOT NULL GROUP BY is_fake""", reviews=True))
def class_weights(t):
    return rounded(E.class_weights(t.reviews(), "is_fake"), ("weight",))


FOLDS_SQL = """folds AS (SELECT platform AS model, fold, split, metric, CASE metric WHEN 'accuracy' THEN acc ELSE base END AS value
FROM (SELECT platform, prediction_id % 5 AS fold, CASE WHEN prediction_id % 2 = 0 THEN 'test' ELSE 'train' END AS split,
 avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc, avg(y_true) AS base FROM scored_v GROUP BY 1, 2, 3)
 CROSS JOIN (VALUES ('accuracy'), ('prevalence')) m(metric))"""


def folds(t):
    wide = t.scored().groupBy(
        C("platform").alias("model"), (C("prediction_id") % 5).alias("fold"),
        F.when(C("prediction_id") % 2 == 0, "test").otherwise("train").alias("split")).agg(
        F.avg((C("y_true") == C("y_pred")).cast("double")).alias("accuracy"), F.avg("y_true").alias("prevalence"))
    return wide.unpivot(["model", "fold", "split"], ["accuracy", "prevalence"], "metric", "value")


@query("cv_summary", with_views(f"""
SELECT model, split, metric, {r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS std FROM folds GROUP BY 1, 2, 3""",
                                scored=True, extra=FOLDS_SQL))
def cv_summary(t):
    return rounded(E.cv_summary(folds(t), ["model"]), ("mean", "std"))


COMPARE_SQL = f"""{CELLS_SQL}, models AS (SELECT platform AS model, {r6('(tp + tn) / n')} AS accuracy,
 {r6('2 * tp / (2 * tp + fp + fn)')} AS f1_score FROM cells)"""


def model_metrics(t):
    out = M.outcome_flags(t.scored()).groupBy(C("platform").alias("model")).agg(
        (F.sum("_good") / F.count("*")).alias("accuracy"),
        (2 * F.sum("_tp") / (2 * F.sum("_tp") + F.sum("_fp") + F.sum("_fn"))).alias("f1_score"))
    return rounded(out, ("accuracy", "f1_score")).unpivot(["model"], ["accuracy", "f1_score"], "metric", "value")


@query("compare_models", with_views("SELECT model, accuracy, f1_score FROM models", scored=True, extra=COMPARE_SQL))
def compare_models(t):
    return E.compare_models(model_metrics(t), ["accuracy", "f1_score"])


@query("best_model", with_views("SELECT model, f1_score AS value FROM models ORDER BY f1_score DESC, model LIMIT 1", scored=True,
                                extra=COMPARE_SQL))
def best_model(t):
    return K.best_by(model_metrics(t).where(C("metric") == "f1_score"), "value", "model").select("model", "value")


# the two halves of the event stream: the second half's value is shifted
FEATURE_SQL = """f AS (SELECT event_id, event_id >= (SELECT (max(event_id) + 1) // 2 FROM events) AS cur, value,
 CASE WHEN event_id >= (SELECT (max(event_id) + 1) // 2 FROM events) THEN value * 1.5 ELSE value END AS shifted,
 CAST(minute(ts) AS DOUBLE) AS minute, CASE WHEN event_id % 9 <> 0 THEN CAST(event_id % 4 AS DOUBLE) END AS quarter,
 CAST(user_id % 2 AS DOUBLE) AS y FROM events),
long AS (SELECT cur, 'value' AS feature, value FROM f UNION ALL SELECT cur, 'shifted', shifted FROM f UNION ALL
 SELECT cur, 'minute', minute FROM f)"""


def halves(t):
    e = t.events()
    middle = (e.agg(F.max("event_id")).first()[0] + 1) // 2
    cur = C("event_id") >= middle
    return e.select(cur.alias("cur"), "value", F.when(cur, C("value") * 1.5).otherwise(C("value")).alias("shifted"),
                    F.minute("ts").cast("double").alias("minute"),
                    F.when(C("event_id") % 9 != 0, (C("event_id") % 4).cast("double")).alias("quarter"),
                    (C("user_id") % 2).cast("double").alias("y"))


def long(t):
    return D.long_features(halves(t), ["cur"], ["value", "shifted", "minute"])


def moments_sql(c):
    m = lambda k: f"avg(pow({c} - mu_{c}, {k}))"
    return f"""SELECT '{c}' AS feature, {r6(f'count(*) FILTER (WHERE {c} IS NULL) / count(*)')} AS missing_rate,
 {r6(f'count(*) FILTER (WHERE {c} = 0) / count(*)')} AS zero_rate, count(DISTINCT {c}) AS unique_values,
 {r6(f'sqrt({m(2)})')} AS std, {r6(f'{m(3)} / pow({m(2)}, 1.5)')} AS skewness, {r6(f'{m(4)} / pow({m(2)}, 2) - 3')} AS kurtosis,
 {r6(f'corr({c}, y)')} AS target_correlation FROM f, mu"""


@query("feature_quality", "WITH " + FEATURE_SQL + """, mu AS (SELECT avg(value) AS mu_value, avg(minute) AS mu_minute,
 avg(quarter) AS mu_quarter FROM f) """ + " UNION ALL ".join(map(moments_sql, ("value", "minute", "quarter"))))
def feature_quality(t):
    out = D.feature_quality(halves(t), ["value", "minute", "quarter"], "y")
    return rounded(out, ("missing_rate", "zero_rate", "std", "skewness", "kurtosis", "target_correlation"))


PSI_SQL = """q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9,
 1.0]))) AS edges FROM long WHERE NOT cur GROUP BY feature),
b AS (SELECT feature, cur, CASE WHEN value < edges[1] OR value > edges[-1] THEN NULL ELSE least(len(list_filter(edges,
 lambda e: e <= long.value)), len(edges) - 1) END AS bin FROM long JOIN q USING (feature)),
s AS (SELECT feature, bin, count(*) FILTER (WHERE NOT cur) AS r, count(*) FILTER (WHERE cur) AS c FROM b GROUP BY 1, 2),
t AS (SELECT feature, count(*) FILTER (WHERE NOT cur) AS ar, count(*) FILTER (WHERE cur) AS ac FROM long GROUP BY 1),
psi AS (SELECT feature, sum((c / ac - r / ar) * ln((c / ac + 1e-6) / (r / ar + 1e-6))) AS psi FROM s JOIN t USING (feature)
 WHERE bin IS NOT NULL GROUP BY feature)"""


@query("psi", f"WITH {FEATURE_SQL}, {PSI_SQL} SELECT feature, {r6('psi')} AS psi FROM psi")
def psi(t):
    return rounded(D.psi(long(t), C("cur")), ("psi",))


@query("sketch_drift", f"""WITH {FEATURE_SQL},
o AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS k, count(*) OVER (PARTITION BY feature) AS m
 FROM long WHERE NOT cur AND value IS NOT NULL),
q AS (SELECT DISTINCT feature, value FROM o JOIN (SELECT unnest(range(1, 10)) AS i) ON k = (i * m + 9) // 10),
u AS (SELECT q.feature, q.value, count(*) FILTER (WHERE NOT cur AND l.value <= q.value) / count(*) FILTER (WHERE NOT cur) AS r,
 count(*) FILTER (WHERE cur AND l.value <= q.value) / count(*) FILTER (WHERE cur) AS c FROM q JOIN long l USING (feature)
 WHERE l.value IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT DISTINCT feature, CAST('inf' AS DOUBLE), 1.0, 1.0 FROM q),
d AS (SELECT feature, r - coalesce(lag(r) OVER w, 0) + 1e-6 AS e, c - coalesce(lag(c) OVER w, 0) + 1e-6 AS a FROM u
 WINDOW w AS (PARTITION BY feature ORDER BY value))
SELECT feature, (SELECT count(*) FROM long x WHERE x.feature = d.feature AND x.cur AND x.value IS NOT NULL) AS n,
 {r6('sum((a - e) * ln(a / e))')} AS psi FROM d GROUP BY feature""")
def sketch_drift(t):
    """The reference is sketched in slices and merged; with as many counters as here the index is exact at this size."""
    rows, k = long(t), 1 << 15
    days = SK.value_sketches(rows.where(~C("cur")).withColumn("day", F.pmod(F.xxhash64("value"), F.lit(7))), ["day"], k)
    now = SK.value_sketches(rows.where("cur"), [], k)
    return rounded(SK.stability(SK.merged_sketches(days, k), now).drop("drift"), ("psi",))


KS_SQL = """v AS (SELECT feature, value, count(*) FILTER (WHERE NOT cur) AS r, count(*) FILTER (WHERE cur) AS c FROM long
 GROUP BY 1, 2),
d AS (SELECT feature, max(abs(rr / ar - rc / ac)) AS d, max(ar) AS n, max(ac) AS m FROM (SELECT *, CAST(sum(r) OVER w AS DOUBLE)
 AS rr, CAST(sum(c) OVER w AS DOUBLE) AS rc, CAST(sum(r) OVER (PARTITION BY feature) AS DOUBLE) AS ar, CAST(sum(c) OVER (PARTITION
 BY feature) AS DOUBLE) AS ac FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)) GROUP BY feature),
l AS (SELECT *, (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * d AS lam FROM d),
ks AS (SELECT feature, d, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101),
 lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2 * j * j * lam * lam))))) END AS p FROM l)"""


@query("ks_test", f"WITH {FEATURE_SQL}, {KS_SQL} SELECT feature, {r6('d')} AS ks_statistic, {r6('p')} AS ks_p_value FROM ks")
def ks_test(t):
    return rounded(D.ks_test(long(t), C("cur")), ("ks_statistic", "ks_p_value"))


@query("feature_drift", f"""WITH {FEATURE_SQL}, {KS_SQL}, {PSI_SQL} SELECT feature, {r6('d')} AS ks_statistic, {r6('p')} AS
 ks_p_value, {r6('psi')} AS psi, p < 0.05 OR psi > 0.25 AS drift_detected FROM ks JOIN psi USING (feature)""")
def feature_drift(t):
    return rounded(D.feature_drift(long(t), C("cur")), ("ks_statistic", "ks_p_value", "psi"))


@query("degradation", with_views(f"""
SELECT platform, max(n) AS window_count, bool_or(base > 0 AND (base - cur) / base > 0.05) AS degraded, coalesce(string_agg(metric,
 '|' ORDER BY metric) FILTER (WHERE base > 0 AND (base - cur) / base > 0.05), '') AS degraded_metrics FROM (UNPIVOT (SELECT
 platform, CAST(n AS BIGINT) AS n, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, (tp + tn) / n AS accuracy, 2 * tp / (2
 * tp + fp + fn) AS f1_score FROM cells) ON precision, recall, accuracy, f1_score INTO NAME metric VALUE cur) JOIN baseline USING
 (metric) GROUP BY platform""", scored=True, extra=f"{CELLS_SQL}, {BASELINE_SQL}"))
def degradation(t):
    c = {n: F.sum(f"_{n}") for n in ("tp", "fp", "fn", "good")}
    metrics = M.outcome_flags(t.scored()).groupBy("platform").agg(
        F.count("*").alias("window_count"),
        *[m.alias(n) for n, m in M.binary_metrics(*c.values(), F.count("*")).items()])
    out = M.degradation(metrics, ["platform"], M.baseline(t.spark, M.EXAMPLE_BASELINE))
    return out.withColumn("degraded_metrics", F.array_join("degraded_metrics", "|"))


@query("bulk_run_summary", with_views(f"""
SELECT count(*) AS total_items, count(CASE WHEN prediction_id % 5 <> 0 THEN risk_level END) AS analyzed,
 count(*) FILTER (WHERE risk_level = 'critical' AND prediction_id % 5 <> 0) AS flagged FROM levels""", scored=True,
                                      extra=LEVELS_SQL))
def bulk_run_summary(t):
    return P.bulk_summary(scored_levels(t).select(F.when(C("prediction_id") % 5 != 0, C("risk_level")).alias("risk_level")))


@query("retraining_reasons", with_views(f"""
SELECT model, unnest(list_filter([CASE WHEN f1 < 0.9 THEN 'performance' END, CASE WHEN drift THEN 'drift' END, CASE WHEN age >= 20
 THEN 'schedule' END, CASE WHEN labels >= 1000 THEN 'new_labels' END], lambda x: x IS NOT NULL)) AS reason FROM (
SELECT platform AS model, 2.0 * sum(y_true * y_pred) / (sum(y_true) + sum(y_pred)) AS f1, avg(value) > 15 AS drift,
 date_diff('day', min(ts)::DATE, DATE '2024-01-25') AS age, count(*) FILTER (WHERE prediction_id % 3 = 0) AS labels FROM scored_v
 GROUP BY platform)""", scored=True))
def retraining_reasons(t):
    s = t.scored().withColumnRenamed("platform", "model")
    metrics = s.groupBy("model").agg((2 * F.sum(C("y_true") * C("y_pred")) / (F.sum("y_true") + F.sum("y_pred"))).alias("f1_score"),
                                     F.min("ts").alias("trained"))
    drift = s.groupBy("model").agg((F.avg("value") > 15).alias("drift"))
    labels = s.groupBy("model").agg(F.count(F.when(C("prediction_id") % 3 == 0, 1)).alias("new_labels"))
    age = F.datediff(t.now(), C("trained"))
    return M.retraining_reasons(metrics, drift, labels, age, max_age_days=20)


@query("impute", f"""
WITH raw AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)
SELECT event_id, {r6('coalesce(v, (SELECT avg(v) FROM raw))')} AS by_mean, {r6('coalesce(v, (SELECT median(v) FROM raw))')} AS
 by_median, coalesce(v, 0.0) AS by_zero FROM raw""")
def impute(t):
    v = F.when(C("event_id") % 7 != 0, C("value"))
    raw = t.base("events").select("event_id", v.alias("by_mean"), v.alias("by_median"), v.alias("by_zero"))
    out = FE.impute(FE.impute(FE.impute(raw, ["by_mean"], "mean"), ["by_median"], "median"), ["by_zero"], "zero")
    return rounded(out, ("by_mean", "by_median"))


@query("scale", f"""
SELECT event_id, {r6('(value - avg(value) OVER ()) / stddev_pop(value) OVER ()')} AS standard,
 {r6('(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())')} AS minmax, CAST(0 AS DOUBLE) AS constant FROM events""")
def scale(t):
    raw = t.base("events").select("event_id", C("value").alias("standard"), C("value").alias("minmax"), F.lit(4.0).alias("constant"))
    return rounded(FE.scale(FE.scale(raw, ["standard", "constant"], "standard"), ["minmax"], "minmax"), ("standard", "minmax"))
