"""Training, scoring, explaining; drift of vectors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trustloom.functions import text as X
from trustloom.operators import drift as D, evaluation as E, forests, learning as L, mmd, ranking as K
from trustloom.plans.aggregates import rounded
from trustloom.plans.registry import query
from trustloom.plans.views import r6, with_views
from trustloom.session import scratch_path, written
from trustloom.sources import models as M

C = F.col
FEATURES = ["text_length", "word_count", "uppercase_ratio", "punctuation_ratio", "rating", "hour"]


def labelled(t):
    text = C("review_text")
    return written(t.reviews().where("is_fake IS NOT NULL").select(
        "review_id", "is_fake", X.text_length(text).alias("text_length"), X.word_count(text).alias("word_count"),
        X.share_of(text, X.UPPER).alias("uppercase_ratio"), X.share_of(text, X.PUNCTUATION).alias("punctuation_ratio"), "rating",
        F.hour("date").alias("hour")), "labelled")


def parts(t):
    rows = written(L.split_stratified(labelled(t), "is_fake", "review_id"), "split")
    train = L.training_rows(rows.where("part = 'train'"), "is_fake", FEATURES)
    test = L.training_rows(rows.where("part = 'test'"), "is_fake", FEATURES)
    return train, test


ORDER_SQL = "CAST('0x' || substr(md5({key} || ':{seed}'), 1, 13) AS BIGINT)"
RANKED_SQL = f"""ranked AS (SELECT review_id, is_fake, row_number() OVER (PARTITION BY is_fake ORDER BY
{ORDER_SQL.format(key='review_id', seed=L.SEED)}, review_id) AS rn, count(*) OVER (PARTITION BY is_fake) AS n FROM reviews_v
WHERE is_fake IS NOT NULL)"""


def labelled_keys(t):
    return t.reviews().where("is_fake IS NOT NULL").select("review_id", "is_fake")


@query("split_stratified", with_views("""
SELECT review_id, is_fake, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM ranked""", reviews=True,
                                      extra=RANKED_SQL))
def split_stratified(t):
    return L.split_stratified(labelled_keys(t), "is_fake", "review_id").select("review_id", "is_fake", "part")


@query("seed", with_views("SELECT review_id, is_fake, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM ranked", reviews=True, extra=RANKED_SQL))
def seed(t):
    return L.with_folds(labelled_keys(t), "is_fake", "review_id").select("review_id", "is_fake", "fold")


@query("sample_rows", f"SELECT event_id, value FROM events ORDER BY {ORDER_SQL.format(key='event_id', seed=L.SEED)}, event_id LIMIT 500")
def sample_rows(t):
    return K.sample_rows(t.base("events").select("event_id", "value"), "event_id", 500, L.SEED)


@query("train_classifiers")
def train_classifiers(t):
    train, test = parts(t)
    return L.train_all(train, test)[1]


@query("select_best")
def select_best(t):
    train, test = parts(t)
    table = L.train_all(train, test)[1]
    return K.best_by(table.where("metric = 'f1_score'"), "value", "model").select("model", "value")


@query("tune_model")
def tune_model(t):
    rows = L.with_folds(labelled(t), "is_fake", "review_id")
    prepared = written(L.training_rows(rows, "is_fake", FEATURES), "folds")
    out = L.tune("logistic_regression", prepared, {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]}, small=True)
    return out.select("model", F.to_json("params").alias("params"), "mean", "std")


@query("batch_predict")
def batch_predict(t):
    train, _ = parts(t)
    model = L.fit("random_forest", train)
    text = C("review_text")
    rows = t.reviews().select(
        "review_id", X.text_length(text).alias("text_length"), X.word_count(text).alias("word_count"),
        X.share_of(text, X.UPPER).alias("uppercase_ratio"), X.share_of(text, X.PUNCTUATION).alias("punctuation_ratio"), "rating",
        F.hour("date").alias("hour"))
    return L.predict(model, L.assembled(rows, FEATURES)).select("review_id", "p_fake")


@query("assemble")
def assemble(t):
    from pyspark.ml.functions import vector_to_array

    return L.training_rows(labelled(t), "is_fake", FEATURES).select("review_id", vector_to_array("features").alias("features"))


@query("save_load_model", with_views("SELECT review_id, true AS same FROM ranked WHERE rn > floor(n * 0.8)", reviews=True,
                                     extra=RANKED_SQL))
def save_load_model(t):
    train, test = parts(t)
    folder = scratch_path(t.spark, "models")
    model = L.fit("logistic_regression", train, small=True)
    M.save_model(t.spark, model, folder, "logistic_regression", {"regParam": 0.01}, L.quality(L.predict(model, test)),
                 train.count(), dt.datetime(2024, 1, 25))
    a = L.predict(model, test).select("review_id", C("p_fake").alias("before"))
    b = L.predict(M.load_model(t.spark, folder), test).select("review_id", C("p_fake").alias("after"))
    return a.join(b, "review_id").select("review_id", (C("before") == C("after")).alias("same"))


@query("model_info", with_views("""
SELECT 'logistic_regression' AS name, '{"regParam":"0.01"}' AS params, 5 AS n_scores, CAST(sum(n) AS BIGINT) AS rows,
  '[' || string_agg('{"is_fake":' || is_fake || ',"rows":' || n || '}', ',' ORDER BY is_fake) || ']' AS classes
FROM (SELECT is_fake, count(*) AS n FROM ranked WHERE rn <= floor(n * 0.8) GROUP BY 1)""", reviews=True, extra=RANKED_SQL))
def model_info(t):
    train, test = parts(t)
    folder = scratch_path(t.spark, "models")
    model = L.fit("logistic_regression", train, small=True)
    M.save_model(t.spark, model, folder, "logistic_regression", {"regParam": 0.01}, L.quality(L.predict(model, test)),
                 train.count(), dt.datetime(2024, 1, 25))
    shares = E.class_distribution(train.select("is_fake"), "is_fake", []).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("is_fake", "rows")))).alias("classes"))
    card = M.cards(t.spark, folder).select("name", F.to_json("params").alias("params"), F.size("scores").alias("n_scores"), "rows")
    return card.withColumn("k", F.lit(0)).join(shares.withColumn("k", F.lit(0)), "k").drop("k")


@query("feature_importance")
def feature_importance(t):
    train, _ = parts(t)
    return L.feature_importance(t.spark, L.fit("random_forest", train), FEATURES)


@query("permutation_importance")
def permutation_importance(t):
    train, test = parts(t)
    return L.permutation_importance(L.fit("random_forest", train), test, "review_id", FEATURES)


@query("partial_dependence")
def partial_dependence(t):
    train, test = parts(t)
    return L.partial_dependence(L.fit("random_forest", train), test, "review_id", FEATURES, "text_length")


# what the test part holds: a fifth of each class
TEST_SQL = "SELECT review_id FROM ranked WHERE rn > floor(n * 0.8)"


@query("forest_contributions", with_views(f"""
SELECT review_id, CAST({len(FEATURES)} AS BIGINT) AS features, true AS adds_up FROM ({TEST_SQL})""", reviews=True, extra=RANKED_SQL))
def forest_contributions(t):
    """Contributions of every test row, held against the forest's own probability."""
    train, test = parts(t)
    model = L.fit("random_forest", train)
    table, base = forests.path_contributions(model, test, "review_id", FEATURES)
    sums = table.groupBy("review_id").agg(F.count("*").alias("features"), F.sum("contribution").alias("s"))
    return sums.join(L.predict(model, test).select("review_id", "p_fake"), "review_id").select(
        "review_id", "features", (F.abs(C("s") + F.lit(base) - C("p_fake")) < 1e-9).alias("adds_up"))


@query("interpretation_report")
def interpretation_report(t):
    """One table of feature and importance per method that ran: the forest's own, permutations, paths and a linear model."""
    train, test = parts(t)
    model = L.fit("random_forest", train)
    linear = L.fit("logistic_regression", train).stages[-1].coefficients.toArray()
    trees = K.top_by(L.feature_importance(t.spark, model, FEATURES), "importance", "feature", 10)
    perm = L.permutation_importance(model, test, "review_id", FEATURES)
    paths, _ = forests.path_contributions(model, test, "review_id", FEATURES)
    linear = L.linear_contributions(test, "review_id", dict(zip(FEATURES, map(float, linear))))
    mean = lambda table, method: table.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")).withColumn(
        "method", F.lit(method))
    return trees.withColumn("method", F.lit("importance")).unionByName(
        perm.select("feature", C("importance_mean").alias("importance"), F.lit("permutation").alias("method"))).unionByName(
        mean(paths, "path")).unionByName(mean(linear, "linear"))


WEIGHTS = {"value": 0.5, "minute": -0.25, "hour": 1.5}
LINEAR_SQL = """f AS (SELECT event_id, value, CAST(minute(ts) AS DOUBLE) AS minute, CAST(hour(ts) AS DOUBLE) AS hour FROM events),
c AS (""" + " UNION ALL ".join(f"SELECT event_id, '{f}' AS feature, {w} * ({f} - avg({f}) OVER ()) AS contribution FROM f"
                               for f, w in WEIGHTS.items()) + ")"


def contributions(t):
    rows = t.events().select("event_id", "value", F.minute("ts").alias("minute"), F.hour("ts").alias("hour"))
    return L.linear_contributions(rows, "event_id", WEIGHTS)


@query("linear_contributions", f"WITH {LINEAR_SQL} SELECT event_id, feature, floor(contribution * 1e4 + 0.5) / 1e4 AS contribution "
       "FROM c")
def linear_contributions(t):
    # four places: the values have seven exact decimals, so six places would round on ties
    return contributions(t).withColumn("contribution", F.floor(C("contribution") * 1e4 + 0.5) / 1e4)


@query("contribution_summary", f"""WITH {LINEAR_SQL} SELECT feature, {r6('avg(abs(contribution))')} AS importance FROM c
GROUP BY feature ORDER BY 2 DESC, 1 LIMIT 2""")
def contribution_summary(t):
    return rounded(E.contribution_summary(contributions(t), 2), ("importance",))


@query("top_features", f"""WITH {LINEAR_SQL} SELECT feature, {r6('max(abs(contribution))')} AS importance FROM c
GROUP BY feature ORDER BY 2 DESC, 1 LIMIT 2""")
def top_features(t):
    table = contributions(t).groupBy("feature").agg(F.max(F.abs("contribution")).alias("importance"))
    return rounded(K.top_by(table, "importance", "feature", 2), ("importance",))


F_SQL = """x AS (SELECT user_id % 3 AS label, value, CAST(minute(ts) AS DOUBLE) AS minute FROM events),
l AS (SELECT label, 'value' AS feature, value AS v FROM x UNION ALL SELECT label, 'minute', minute FROM x),
c AS (SELECT feature, label, count(*) AS n, avg(v) AS m, var_pop(v) AS p FROM l GROUP BY 1, 2),
g AS (SELECT feature, avg(v) AS gm FROM l GROUP BY 1)"""


@query("select_features", f"""WITH {F_SQL} SELECT feature, {r6('(sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * p) / (sum(n) - count(*)))')}
 AS f_score FROM c JOIN g USING (feature) GROUP BY feature""")
def select_features(t):
    rows = t.events().select((C("user_id") % 3).alias("label"), "value", F.minute("ts").alias("minute"))
    return rounded(L.f_scores(rows, "label", ["value", "minute"]), ("f_score",))


@query("ensemble_vote", with_views(f"""
SELECT prediction_id AS id, {r6("(0.25 * a + 0.35 * b + 0.15 * c) / 0.75")} AS p_fake FROM (SELECT prediction_id, p_fake AS a,
 CAST((prediction_id * 31) % 100 AS DOUBLE) / 100 AS b, CAST((prediction_id * 17) % 100 AS DOUBLE) / 100 AS c FROM scored_v)""",
                                   scored=True))
def ensemble_vote(t):
    pid = C("prediction_id")
    wide = t.scored().select(pid.alias("id"), C("p_fake").alias("random_forest"),
                             ((pid * 31) % 100).cast("double").__truediv__(100).alias("boosted_trees"),
                             ((pid * 17) % 100).cast("double").__truediv__(100).alias("linear_svc"))
    long = wide.unpivot(["id"], ["random_forest", "boosted_trees", "linear_svc"], "model", "p_fake")
    return rounded(L.ensemble_vote(long), ("p_fake",))


@query("smote", """
SELECT CASE WHEN label = 3 THEN 1 ELSE 0 END AS y, count(*) AS originals, max(CASE WHEN label = 3 THEN other - mine ELSE 0 END) AS
 synthetic FROM embeddings, (SELECT count(*) FILTER (WHERE label <> 3) AS other, count(*) FILTER (WHERE label = 3) AS mine FROM
 embeddings) GROUP BY 1""")
def smote(t):
    rows = t.base("embeddings").select("vec_id", C("embedding").cast("array<double>").alias("v"),
                                       F.when(C("label") == 3, 1).otherwise(0).alias("y"))
    out = L.smote(rows, "vec_id", "y", "v", 1)
    return out.groupBy("y").agg(F.count(F.when(~C("synthetic"), 1)).alias("originals"),
                                F.count(F.when(C("synthetic"), 1)).alias("synthetic"))


@query("word2vec")
def word2vec(t):
    docs = written(t.reviews().select("review_id", X.terms(C("review_text")).alias("terms")), "terms")
    return L.word_vectors(docs, "review_id", "terms")


@query("mmd_drift")
def mmd_drift(t):
    e = t.base("embeddings")
    moved = F.when(C("label") % 2 == 1, F.transform("embedding", lambda x: x + 0.05)).otherwise(C("embedding"))
    return mmd.mmd_drift(e.select("vec_id", "label", moved.alias("v")), "vec_id", "v", C("label") % 2 == 1)


@query("drift_reference_refresh", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def drift_reference_refresh(t):
    return D.last_rows(t.events().select("event_id", "ts", "value"), "ts", "event_id", 1000).select("event_id", "value")
