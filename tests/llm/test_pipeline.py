"""The pipeline against plain Python versions of its stages, and the registration of the operators."""

import importlib.util
import pathlib
import sys

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
import __spark_entry__ as entrypoint  # noqa: E402
import corpus_pipeline  # noqa: E402
from trustloom.llm import quality, simhash  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, small):
    """What every stage of the pipeline got and gave, over the smallest tables."""
    from trustloom.llm.common import stored

    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, small), name)
        steps.append((name, docs, out))
        docs = out
    return steps


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "exact_dedup", "near_dedup", "packing"]
    names = entrypoint.queries()
    for k in range(1, 14):
        assert len([n for n in names if n.startswith(f"op{k}_")]) == 1
    assert "pipeline" in names and set(entrypoint.oracle_sql()) <= set(names)
    assert importlib.util.find_spec("trustloom.llm")


def test_columns_stay(tables):
    for _, docs, out in tables[:-1]:
        assert out.schema == docs.schema


def test_rules_stage(tables):
    _, docs, out = tables[0]
    want = {r.id for r in quality.verdicts(docs).where("kept").collect()}
    assert {r.doc_id for r in out.collect()} == want and len(want) < docs.count()


def test_classifier_keeps_clean(spark, small, tables):
    _, docs, out = tables[1]
    clean = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in (docs, out))
    assert after <= before and len(after & clean) >= 0.98 * len(before & clean)


def test_exact_stage(tables):
    _, docs, out = tables[2]
    best = {}
    for r in docs.collect():
        best[r.text] = max(r.doc_id, best.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in out.collect()) == sorted(best.values())


def test_near_stage(tables):
    _, docs, out = tables[3]
    rows = docs.collect()
    fps = [simhash.fingerprint(r.text.encode(), 3) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 2):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(r.doc_id, low.get(find(i), r.doc_id))
    assert sorted(r.doc_id for r in out.collect()) == sorted(low.values())


def test_packing_stage(tables):
    _, docs, out = tables[4]
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert -(-total // 1024) <= len(bins) <= 1.02 * total / 1024 + 2


def test_run_is_the_stages(spark, small, tables):
    got = corpus_pipeline.run(spark, small)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, tables[-1][2].select(keys).collect()))


def test_pipeline_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_stages_with_clashing_columns_and_odd_ids(spark, small):
    """Names the stages use themselves, null ids and one id for different texts change nothing: rows go by their own text."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("row", F.monotonically_increasing_id())
    odd = docs.withColumn("doc_id", F.when(F.col("row") % 5 == 0, None).when(F.col("row") % 5 == 1, 7).otherwise(F.col("doc_id")))
    for name in ("_away", "_sha", "_id", "_document", "_kept", "_trusted", "key", "id"):
        odd = odd.withColumn(name, F.col("row") + 1)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns and out.where("_sha = row + 1 AND id = row + 1").count() == out.count() > 0
    rules = {r.row for r in corpus_pipeline.quality_rules(spark, odd, small).select("row").collect()}
    assert rules == {r.row for r in corpus_pipeline.quality_rules(spark, docs, small).select("row").collect()}
