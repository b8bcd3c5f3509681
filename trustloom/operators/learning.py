"""Training, tuning, scoring and explaining classifiers with MLlib.

Only fitted parameters and small metric tables reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trustloom.functions.numeric import hash_unit, md5_order
from trustloom.operators import cooccurrence
from trustloom.operators.evaluation import class_weights
from trustloom.operators.ordered import quantiles, row_numbers
from trustloom.operators.similarity import nearest
from trustloom.session import written

SEED = 42
ENSEMBLE = {"random_forest": 0.25, "boosted_trees": 0.35, "neural_network": 0.25, "linear_svc": 0.15}
FALLBACK = 0.5


def estimators(seed: int = SEED, small: bool = False) -> dict:
    """The classifiers by name; ``small`` keeps ensembles short for trial runs."""
    trees, rounds = (10, 5) if small else (100, 50)
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic_regression": LogisticRegression(maxIter=20, regParam=0.01, **common),
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=5, seed=seed, **common),
        "linear_svc": LinearSVC(maxIter=20, regParam=0.01, **common),
        "boosted_trees": GBTClassifier(maxIter=rounds, maxDepth=3, seed=seed, **common),
    }


def _ranked(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Position of each row of its class in a hash order."""
    return row_numbers(df.withColumn("_h", md5_order(F.col(key), seed)), [label], ["_h", key]).drop("_h")


def split_stratified(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = SEED) -> DataFrame:
    """Add ``part`` ('train' or 'test') with the exact share of every class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    ranked = _ranked(df, label, key, seed).join(sizes, label)
    return ranked.withColumn("part", F.when(F.col("rn") <= F.floor(F.col("_n") * share), "train").otherwise("test")).drop("rn", "_n")


def with_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    return _ranked(df, label, key, seed).withColumn("fold", ((F.col("rn") - 1) % folds).cast("int")).drop("rn")


def assembled(df: DataFrame, features: Sequence[str], fill: bool = False) -> DataFrame:
    """Rows with their feature vector, as scoring needs them: no label, no weight. A row with a missing feature keeps NaN
    there (and gets the neutral probability), unless ``fill`` puts 0."""
    rows = df.fillna(0, list(features)) if fill else df
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(rows)


def training_rows(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Assembled features, numeric label and balanced class weight (one row per class, broadcast)."""
    weights = F.broadcast(class_weights(df, label).select(label, "weight"))
    rows = df.where(F.col(label).isNotNull()).join(weights, label)
    return assembled(rows, features, fill=True).withColumn("label", F.col(label).cast("double"))


def fit(name: str, rows: DataFrame, seed: int = SEED, small: bool = False) -> PipelineModel:
    """Fit one classifier. The linear SVM gets a probability from a one-feature logistic fit on its margin."""
    model = estimators(seed, small)[name]
    if name != "linear_svc":
        return Pipeline(stages=[model]).fit(rows)
    model = model.setRawPredictionCol("margin").setPredictionCol("svc_prediction")
    calibrate = LogisticRegression(featuresCol="margin", labelCol="label", weightCol="weight", maxIter=20)
    return Pipeline(stages=[model, calibrate]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``p_fake``; a row that gives no probability gets the neutral value."""
    p = vector_to_array("probability")[1]
    return model.transform(rows).withColumn("p_fake", F.when(p.isNull() | F.isnan(p), FALLBACK).otherwise(p))


def quality(scored: DataFrame) -> dict[str, float]:
    area = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label")
    by = lambda m: MulticlassClassificationEvaluator(labelCol="label", metricName=m).evaluate(scored)
    return {"roc_auc": area.evaluate(scored), "accuracy": by("accuracy"), "f1_score": by("f1"),
            "precision": by("weightedPrecision"), "recall": by("weightedRecall")}


def train_all(train: DataFrame, test: DataFrame, names=None, seed: int = SEED, small: bool = False) -> tuple[dict, DataFrame]:
    """Fit every classifier; one that fails is recorded with its error and the others go on."""
    models, rows = {}, []
    for name in names or estimators(seed, small):
        try:
            models[name] = fit(name, train, seed, small)
            rows += [(name, m, float(v), None) for m, v in quality(predict(models[name], test)).items()]
        except Exception as exc:
            rows.append((name, "error", None, type(exc).__name__))
    if not models:
        raise RuntimeError("no classifier could be trained")
    return models, train.sparkSession.createDataFrame(rows, "model STRING, metric STRING, value DOUBLE, error STRING")


def tune(name: str, rows: DataFrame, grid: dict[str, list], fold_col: str = "fold", parallelism: int = 4,
         small: bool = False) -> DataFrame:
    """Grid search over stratified folds: one row per setting with the mean and deviation of its area."""
    model = estimators(small=small)[name]
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(model.getParam(param), values)
    maps = builder.build()
    folds = rows.agg(F.max(fold_col)).first()[0] + 1
    cv = CrossValidator(estimator=model, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol="label"),
                        numFolds=folds, foldCol=fold_col, parallelism=parallelism).fit(rows)
    out = [(name, {p.name: str(v) for p, v in m.items()}, float(a), float(s)) for m, a, s in
           zip(maps, cv.avgMetrics, cv.stdMetrics)]
    return rows.sparkSession.createDataFrame(out, "model STRING, params MAP<STRING,STRING>, mean DOUBLE, std DOUBLE")


def ensemble_vote(scores: DataFrame, weights: dict[str, float] = ENSEMBLE) -> DataFrame:
    """Weighted mean probability per item from one row per (item, model); weights of absent models are left out."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = F.element_at(table, F.col("model"))
    return scores.withColumn("_w", w).where("_w IS NOT NULL").groupBy("id").agg(
        (F.sum(F.col("p_fake") * F.col("_w")) / F.sum("_w")).alias("p_fake"))


def feature_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Tree importances, or absolute coefficients of a linear model."""
    stage = model.stages[0]
    values = stage.featureImportances if hasattr(stage, "featureImportances") else stage.coefficients
    rows = [(f, abs(float(v))) for f, v in zip(features, values.toArray())]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE")


def _replaced(features: Sequence[str]):
    """Feature vector with the element of the row's ``feature`` replaced by ``value``."""
    return array_to_vector(F.array(*[
        F.when(F.col("feature") == f, F.col("value")).otherwise(F.col(f).cast("double")) for f in features]))


def scorings() -> dict[str, Column]:
    """Aggregates over scored rows by name; larger is better."""
    right, hit = (F.col("prediction") == F.col("label")).cast("double"), (F.col("prediction") == 1) & (F.col("label") == 1)
    found, said, true = (F.count_if(c) for c in (hit, F.col("prediction") == 1, F.col("label") == 1))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    gap = vector_to_array("probability")[1] - F.col("label")
    return {"accuracy": F.avg(right), "precision": zero(found, said), "recall": zero(found, true),
            "f1_score": zero(2 * found, said + true), "neg_brier": -F.avg(gap * gap)}


def permutation_importance(model: PipelineModel, rows: DataFrame, key: str, features: Sequence[str], repeats: int = 5,
                           seed: int = SEED, scoring: str = "accuracy") -> DataFrame:
    """Drop in a score (see :func:`scorings`) when one feature's values are exchanged among the rows.

    Every (feature, repeat) exchange is one slice of the same job: rows by key order receive values by hash order.
    """
    base = written(rows.select(key, "label", *[F.col(f).cast("double").alias(f) for f in features]), "explained")
    numbered = row_numbers(base, [], [key])
    slices = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("rep"))
                                 for f in features for r in range(repeats)]))
    donors = base.withColumn("_s", slices).select("_s.feature", "_s.rep", key, *features)
    own = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in features])
    drawn = donors.select("feature", "rep", F.xxhash64(key, "feature", "rep", F.lit(seed)).alias("_h"), key, own.alias("value"))
    given = row_numbers(drawn, ["feature", "rep"], ["_h", key]).select("feature", "rep", "rn", "value")
    hit = scorings()[scoring]
    plain = model.transform(base.withColumn("features", array_to_vector(F.array(*features)))).agg(hit).first()[0]
    scored = model.transform(numbered.join(given, "rn").withColumn("features", _replaced(features)))
    per = scored.groupBy("feature", "rep").agg((F.lit(plain) - hit).alias("drop"))
    return per.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))


def partial_dependence(model: PipelineModel, rows: DataFrame, key: str, features: Sequence[str], target: str,
                       points: int = 10, individual: bool = False) -> DataFrame:
    """Mean prediction while one feature takes each value of a grid between its 5 % and 95 % quantiles; with
    ``individual`` the prediction of every row at every value instead."""
    base = rows.select(key, *[F.col(f).cast("double").alias(f) for f in features])
    q = quantiles(base, [], target, [0.05, 0.95]).first()
    low, high = q["q0"], q["q1"]
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]
    spread = base.withColumns({"feature": F.lit(target), "value": F.explode(F.array(*map(F.lit, grid)))})
    scored = predict(model, spread.withColumn("features", _replaced(features)))
    if individual:
        return scored.select(key, "feature", "value", F.col("p_fake").alias("prediction"))
    return scored.groupBy("feature", "value").agg(F.avg("p_fake").alias("mean_prediction"),
                                                  F.stddev_pop("p_fake").alias("spread"))


def linear_contributions(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Exact contribution of each feature of a linear model: weight times distance from the feature's mean."""
    means = df.agg(*[F.avg(f).alias(f) for f in weights]).first()
    parts = [(w * (F.col(f).cast("double") - F.lit(means[f]))).alias(f) for f, w in weights.items()]
    return df.select(key, *parts).unpivot([key], list(weights), "feature", "contribution")


def f_scores(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """One-way F statistic of each feature against the classes, from class-wise moments."""
    long = df.select(label, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([label], list(features), "feature", "value")
    cell = long.groupBy("feature", label).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    whole = long.groupBy("feature").agg(F.avg("value").alias("gm"))
    between = F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm")))
    within = F.sum(F.col("n") * F.col("v"))
    k, n = F.count("*"), F.sum("n")
    return cell.join(whole, "feature").groupBy("feature").agg(
        F.when(within > 0, (between / (k - 1)) / (within / (n - k))).alias("f_score"))


def select_features(rows: DataFrame, features: Sequence[str], method: str, k: int, seed: int = SEED) -> list[str]:
    """Names of the ``k`` best features by F statistic, by forest importance, or by dropping the weakest in turn."""
    names = list(features)
    if method == "univariate":
        chooser = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="picked", selectionMode="numTopFeatures")
        picked = chooser.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k).fit(rows)
        return [names[i] for i in picked.selectedFeatures]

    def importances(current):
        part = VectorAssembler(inputCols=current, outputCol="_f", handleInvalid="keep").transform(rows)
        forest = RandomForestClassifier(featuresCol="_f", labelCol="label", numTrees=10, seed=seed).fit(part)
        return dict(zip(current, forest.featureImportances.toArray()))

    if method == "importance":
        found = importances(names)
        return sorted(names, key=lambda f: (-found[f], f))[:k]
    if method == "rfe":
        while len(names) > k:
            found = importances(names)
            names.remove(min(names, key=lambda f: (found[f], f)))
        return names
    raise ValueError(f"unknown method {method}")


def word_vectors(df: DataFrame, key: str, tokens: str, size: int = 100, window: int = 5, min_count: int = 2,
                 seed: int = SEED, rounds: int = 4) -> DataFrame:
    """Mean word vector of each text; the words' vectors are learned and kept in tables (:mod:`trustloom.operators.cooccurrence`)."""
    table = cooccurrence.vectors(df, tokens, size, window, min_count, seed, rounds)
    return cooccurrence.text_vectors(df, key, tokens, table, size)



def smote(df: DataFrame, key: str, label: str, vector: str, minority, k: int = 5, seed: int = SEED) -> DataFrame:
    """Original rows plus synthetic minority rows up to the size of the largest class.

    A synthetic row lies between a minority row and one of its ``k`` nearest minority rows; other columns come from the base row.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    have = sizes.get(minority, 0)
    if have < 2:
        raise ValueError(f"{have} rows of the minority class {minority!r}: synthetic rows need two to lie between")
    need = max(sizes.values()) - have
    small = written(df.where(F.col(label) == F.lit(minority)), "minority")
    near = nearest(small, key, vector, k).select(key, "neighbor", "position")
    numbered = row_numbers(small, [], [key])
    each, rest = divmod(need, have)
    copies = F.lit(each) + F.when(F.col("rn") <= rest, 1).otherwise(0)
    bases = numbered.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("rn")
    pick = 1 + F.pmod(F.xxhash64(key, "copy", F.lit(seed)), F.lit(max(min(k, have - 1), 1)))
    others = small.select(F.col(key).alias("neighbor"), F.col(vector).alias("_to"))
    drawn = bases.withColumn("position", pick.cast("int")).join(near, [key, "position"]).join(others, "neighbor")
    u = hash_unit(F.col(key), F.col("copy"), F.lit(seed + 1))
    mixed = F.zip_with(vector, "_to", lambda a, b: a + F.col("_u") * (b - a))
    made = drawn.withColumn("_u", u).withColumn(vector, mixed).withColumn("synthetic", F.lit(True)).select(*df.columns, "synthetic")
    return df.withColumn("synthetic", F.lit(False)).unionByName(made)
