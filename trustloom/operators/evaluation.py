"""Evaluation of scored rows: counts, rates, curves and areas, all as aggregations.

Curves first reduce the rows to distinct scores, then take running totals over shards of the score order, so neither one
model with all the rows nor one frequent score lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trustloom.operators.ordered import group_key, running_sums

def class_distribution(df: DataFrame, label: str, group: list[str]) -> DataFrame:
    """Rows and share per label within each group."""
    counts = df.groupBy(*group, label).agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(W.partitionBy(*(group or [F.lit(0)])))
    return counts.withColumn("share", F.col("rows") / total)


def confusion_matrix(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """Counts for every pair of classes, zeros included, with shares by true class, by predicted class and of all."""
    counts = df.groupBy(*group, F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("rows"))
    # the result holds every pair of classes of every group, so one row with the classes is never the largest thing here
    classes = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).groupBy(F.lit(0).alias("_k")).agg(
        F.array_sort(F.collect_set("c")).alias("labels"))
    groups = (counts.select(*group).distinct() if group else df.sparkSession.range(1)).withColumn("_k", F.lit(0))
    grid = groups.join(F.broadcast(classes), "_k").select(*group, "labels", F.explode("labels").alias("actual")).select(
        *group, "actual", F.explode("labels").alias("predicted"))
    seen = counts.select(group_key(group).alias("_g"), "actual", "predicted", "rows")
    full = grid.withColumn("_g", group_key(group)).join(seen, ["_g", "actual", "predicted"], "left").select(
        *group, "actual", "predicted", F.coalesce("rows", F.lit(0)).alias("rows"))
    whole = [F.lit(0)] if not group else group

    def share(*keys):
        total = F.sum("rows").over(W.partitionBy(*whole, *keys))
        return F.when(total > 0, F.col("rows") / total).otherwise(F.lit(0.0))

    return full.withColumns({"by_true": share("actual"), "by_pred": share("predicted"), "of_all": share()})


def _per_class(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """True positives, support and predictions per class, from one pass of counts by (actual, predicted)."""
    counts = df.groupBy(*group, F.col(y).alias("a"), F.col(p).alias("b")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
                    F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))
    hit = F.when((F.col("a") == F.col("b")) & (F.col("s.support") > 0), F.col("n")).otherwise(0)
    return counts.withColumn("s", F.explode(sides)).groupBy(*group, F.col("s.label").alias("label")).agg(
        F.sum(hit).alias("tp"), F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"))


def _zero_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_rates(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return _per_class(df, group, y, p).withColumns({
        "precision": _zero_ratio(tp, predicted), "recall": _zero_ratio(tp, support),
        "f1_score": _zero_ratio(2 * tp, support + predicted)})


def classification_metrics(df: DataFrame, group: list[str], y: str, p: str, positive=1) -> DataFrame:
    """Accuracy, support-weighted precision, recall and F1, correlation, and the rates of a binary label."""
    rates = class_rates(df, group, y, p)
    n = F.sum("support")
    weighted = lambda c: _zero_ratio(F.sum(F.col(c) * F.col("support")), n)
    pick = lambda c, is_pos: F.sum(F.when((F.col("label") == F.lit(positive)) == F.lit(is_pos), F.col(c)).otherwise(0))
    num = F.sum("tp").cast("double") * n - F.sum(F.col("support").cast("double") * F.col("predicted"))
    var_p = n.cast("double") * n - F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    var_t = n.cast("double") * n - F.sum(F.col("support").cast("double") * F.col("support"))
    return rates.groupBy(*group).agg(
        n.alias("rows"), _zero_ratio(F.sum("tp"), n).alias("accuracy"), weighted("precision").alias("precision"),
        weighted("recall").alias("recall"), weighted("f1_score").alias("f1_score"),
        _zero_ratio(pick("tp", False), pick("support", False)).alias("specificity"), weighted("recall").alias("sensitivity"),
        _zero_ratio(pick("tp", True), pick("support", True)).alias("tpr"),
        _zero_ratio(num, F.sqrt(var_p) * F.sqrt(var_t)).alias("mcc"))


def cohen_kappa(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    n = F.sum("support")
    agree = F.sum("tp") / n
    chance = F.sum(F.col("support").cast("double") * F.col("predicted")) / (n.cast("double") * n)
    return _per_class(df, group, y, p).groupBy(*group).agg(
        F.when(chance < 1, (agree - chance) / (1 - chance)).otherwise(F.lit(0.0)).alias("kappa"))


def classification_report(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """One row per class plus accuracy, macro and weighted averages."""
    rates = class_rates(df, group, y, p)
    cols = ("precision", "recall", "f1_score")
    classes = rates.select(*group, F.col("label").cast("string").alias("label"), *cols, "support")
    n = F.sum("support")
    accuracy = _zero_ratio(F.sum("tp"), n)
    weigh = lambda c: _zero_ratio(F.sum(F.col(c) * F.col("support")), n)
    wide = rates.groupBy(*group).agg(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(c) for c in cols], n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in cols], n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[weigh(c).alias(c) for c in cols], n.alias("support"))).alias("s"))
    summary = wide.select(*group, F.explode("s").alias("r")).select(*group, "r.*")
    return classes.unionByName(summary)


def _score_points(df: DataFrame, group: list[str], y: Column, score: str) -> DataFrame:
    rows = df.where(F.col(score).isNotNull() & y.isNotNull()).select(
        *group, F.col(score).alias("threshold"), F.when(y, 1).otherwise(0).alias("pos"), F.when(y, 0).otherwise(1).alias("neg"))
    return running_sums(rows, group, "threshold", ["pos", "neg"], descending=True)


def _totals(points: DataFrame, group: list[str]) -> DataFrame:
    """Add the group's positives and negatives to each point (one small row per group)."""
    if not group:
        sums = points.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")).first()
        return points.withColumns({c: F.lit(sums[c]) for c in ("all_pos", "all_neg")})
    keyed = points.withColumn("_g", group_key(group))
    return keyed.join(keyed.groupBy("_g").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")), "_g").drop("_g")


def roc_curve(df: DataFrame, group: list[str], y: Column, score: str) -> DataFrame:
    """Rates at every distinct threshold."""
    points = _totals(_score_points(df, group, y, score), group)
    return points.select(*group, "threshold", _zero_ratio(F.col("run_neg"), F.col("all_neg")).alias("fpr"),
                         _zero_ratio(F.col("run_pos"), F.col("all_pos")).alias("tpr"))


def pr_curve(df: DataFrame, group: list[str], y: Column, score: str) -> DataFrame:
    points = _totals(_score_points(df, group, y, score), group)
    return points.select(*group, "threshold", (F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))).alias("precision"),
                         _zero_ratio(F.col("run_pos"), F.col("all_pos")).alias("recall"))


def roc_auc(df: DataFrame, group: list[str], y: Column, score: str) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half."""
    points = _score_points(df, group, y, score)
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    wins = F.sum(F.col("neg").cast("double") * (F.col("run_pos") - F.col("pos") * F.lit(0.5)))
    return points.groupBy(*group).agg(pos.cast("bigint").alias("positives"), _zero_ratio(wins, pos * neg).alias("roc_auc"))


def pr_auc(df: DataFrame, group: list[str], y: Column, score: str) -> DataFrame:
    """Average precision: each recall step times the precision there."""
    points = _score_points(df, group, y, score)
    step = F.col("pos").cast("double") * F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))
    return points.groupBy(*group).agg(_zero_ratio(F.sum(step), F.sum("pos").cast("double")).alias("pr_auc"))


def roc_auc_ovr(long: DataFrame, group: list[str], class_col: str, y: Column, score: str) -> DataFrame:
    """One-vs-rest area weighted by class support, from one row per (item, class)."""
    per_class = roc_auc(long, [*group, class_col], y, score)
    return per_class.groupBy(*group).agg(
        _zero_ratio(F.sum(F.col("roc_auc") * F.col("positives")), F.sum("positives")).alias("roc_auc"))


def probability_histogram(df: DataFrame, score: str, group: list[str]) -> DataFrame:
    """Cumulative counts at 0.0, 0.1 ... 1.0: one pass of conditional counts."""
    edges = [i / 10 for i in range(11)]
    wide = df.groupBy(*group).agg(*[F.count(F.when(F.col(score) <= e, 1)).alias(f"b{i}") for i, e in enumerate(edges)])
    rows = F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("rows")) for i, e in enumerate(edges)])
    return wide.select(*group, F.explode(rows).alias("r")).select(*group, "r.le", "r.rows")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows over classes times rows of the class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))
    everything = W.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sum("rows").over(everything) / (F.count("*").over(everything) * F.col("rows")))


def cv_summary(folds: DataFrame, group: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    return folds.groupBy(*group, "split", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def compare_models(long: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per model with a column per metric, best F1 first."""
    return long.groupBy("model").pivot("metric", metrics).agg(F.first("value")).orderBy(F.col("f1_score").desc(), "model")


def contribution_summary(df: DataFrame, n: int) -> DataFrame:
    """Features by mean absolute contribution."""
    mean = df.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    return mean.orderBy(F.col("importance").desc(), "feature").limit(n)
