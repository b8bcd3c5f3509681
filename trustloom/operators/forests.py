"""Exact contributions of features to each prediction of a tree model, from the node table of the stored model.

On its way from the root to a leaf a row's value changes at every split; the change belongs to the split's feature. All
changes of a leaf are known from the nodes alone, so they are put into one row per leaf by climbing the node table level by level,
and a row of data only needs the leaves it falls into, which the model itself gives. Base value and contributions add up
to the prediction: the probability of class 1 of a forest or a tree, the margin of boosted trees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from trustloom.session import scratch_path, written

LEAF_BYTES = 16 << 20  # leaf tables up to this size are broadcast


def node_table(spark: SparkSession, model) -> DataFrame:
    """``tree, id, value, weight, left, right, feature`` of every node of a stored tree, forest or boosted model.

    Node numbers go down the left side first; a leaf has no children (-1). The value is the node's share of class 1, or its
    prediction in boosted trees; the weight is what the tree counts in the whole.
    """
    path = scratch_path(spark, "tree-model")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" not in data.columns:  # a single tree
        data = data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData"))
    node = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    weights = list(getattr(model, "treeWeights", [1.0]))
    boosted = type(model).__name__.startswith("GBT")
    shares = F.col("impurityStats")[1] / F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    weight = F.get(F.array(*map(F.lit, weights)), F.col("tree")) / (1.0 if boosted else sum(weights))
    return written(node.select("tree", "id", (F.col("prediction") if boosted else shares).alias("value"), weight.alias("weight"),
                               F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature")), "nodes")


def leaf_contributions(nodes: DataFrame, n_features: int) -> tuple[DataFrame, float]:
    """``tree, leaf, changes`` with one number per feature, times the tree's weight, and the base value: that of all roots.

    Leaves have the numbers that the model's leaf column gives: their order within the tree.
    """
    zeros = F.array_repeat(F.lit(0.0), n_features)
    now = nodes.where("id = 0").withColumn("changes", zeros)
    base = now.agg(F.sum(F.col("value") * F.col("weight"))).first()[0]
    child = nodes.select("tree", F.col("id").alias("c"), F.col("value").alias("v"), F.col("left").alias("l"), F.col("right").alias("r"),
                         F.col("feature").alias("f"))
    leaves = []
    while True:
        now = written(now, "tree-level")
        leaves.append(now.where("left < 0").select("tree", "id", "changes"))
        inner = now.where("left >= 0")
        if inner.isEmpty():
            break
        step = (F.col("v") - F.col("value")) * F.col("weight")
        moved = F.transform("changes", lambda x, i: F.when(i == F.col("feature"), x + step).otherwise(x))
        now = inner.withColumn("c", F.explode(F.array("left", "right"))).join(child, ["tree", "c"]).withColumn("moved", moved).select(
            "tree", F.col("c").alias("id"), F.col("v").alias("value"), "weight", F.col("l").alias("left"), F.col("r").alias("right"),
            F.col("f").alias("feature"), F.col("moved").alias("changes"))
    out = leaves[0]
    for level in leaves[1:]:
        out = out.unionByName(level)
    order = F.row_number().over(W.partitionBy("tree").orderBy("id")) - 1  # a tree's leaves, not data
    return written(out.select("tree", order.alias("leaf"), "changes"), "leaf-changes"), base


def path_contributions(model: PipelineModel, rows: DataFrame, key: str, features: Sequence[str]) -> tuple[DataFrame, float]:
    """``key, feature, contribution`` of every row with a ``features`` vector, and the base value of the model.

    The trees of a row are added up in its task, so what is shuffled is one row of numbers per row of data. Null vectors are
    left out; rows that repeat a key are added up.
    """
    stage = model.stages[-1]
    leaves, base = leaf_contributions(node_table(rows.sparkSession, stage), len(features))
    known = leaves.count()
    leaves = F.broadcast(leaves) if known * (8 * len(features) + 32) <= LEAF_BYTES else leaves
    scored = stage.copy({stage.leafCol: "_leaves"}).transform(rows.where("features IS NOT NULL").select(key, "features"))
    one = scored.schema["_leaves"].dataType.simpleString() == "double"  # a single tree gives a number
    fallen = scored.select(key, F.posexplode(F.array("_leaves") if one else vector_to_array("_leaves")).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))
    sums = fallen.join(leaves, ["tree", "leaf"]).groupBy(key).agg(*[
        F.sum(F.col("changes")[i]).alias(f"c{i}") for i in range(len(features))])
    wide = sums.select(key, *[F.col(f"c{i}").alias(f) for i, f in enumerate(features)])
    return wide.unpivot([key], list(features), "feature", "contribution"), base
