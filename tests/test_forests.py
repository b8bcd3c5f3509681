import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from trustloom.operators import forests

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(200):
        x = [rng.random(), rng.randrange(4) / 1.0, rng.random()]
        data.append((i, x, float(x[0] + x[1] * 0.3 + rng.random() * 0.3 > 0.9)))
    return spark.createDataFrame(data, "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_contributions_add_up(rows, kind):
    estimator = {"tree": DecisionTreeClassifier(maxDepth=3), "forest": RandomForestClassifier(numTrees=4, maxDepth=4, seed=1),
                 "boosted": GBTClassifier(maxIter=4, maxDepth=3, seed=1)}[kind]
    model = PipelineModel([estimator.fit(rows)])
    table, base = forests.path_contributions(model, rows, "id", NAMES)
    sums = {r.id: base + r.s for r in table.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    scored = model.transform(rows)
    value = vector_to_array("rawPrediction")[1] if kind == "boosted" else vector_to_array("probability")[1]
    want = {r.id: r.p for r in scored.select("id", value.alias("p")).collect()}
    assert sums == pytest.approx(want) and len({round(v, 6) for v in want.values()}) > 2
    assert table.count() == 3 * 200


def test_changes_of_a_leaf_are_those_on_its_path(spark, rows):
    """Against a walk down each tree by the stored thresholds."""
    fitted = RandomForestClassifier(numTrees=3, maxDepth=4, seed=2).fit(rows)
    table, base = forests.path_contributions(PipelineModel([fitted]), rows.where("id < 40"), "id", NAMES)
    got = {(r.id, r.feature): r.contribution for r in table.collect()}
    path = forests.scratch_path(spark, "model")
    fitted.write().save(path)
    nodes = {(r.treeID, r.nodeData.id): r.nodeData for r in spark.read.parquet(f"{path}/data").collect()}
    share = lambda n: n.impurityStats[1] / sum(n.impurityStats)
    assert base == pytest.approx(sum(share(nodes[t, 0]) for t in range(3)) / 3)
    for r in rows.where("id < 40").collect():
        want = dict.fromkeys(NAMES, 0.0)
        for t in range(3):
            at = nodes[t, 0]
            while at.leftChild >= 0:
                f = at.split.featureIndex
                down = nodes[t, at.leftChild if r.x[f] <= at.split.leftCategoriesOrThreshold[0] else at.rightChild]
                want[NAMES[f]] += (share(down) - share(at)) / 3
                at = down
        assert {f: got[r.id, f] for f in NAMES} == pytest.approx(want)
