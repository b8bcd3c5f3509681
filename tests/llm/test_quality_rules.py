import math
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trustloom.llm import quality

DOCS = "doc_id long, text string, lang string, id string, w string, n_words string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", "b", "c", 1) for i, t in rows], DOCS)


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    hit = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def samples():
    rng = random.Random(1)
    out = ["", None, " \n\t", "one", "a b c d e a b c d e", "x " * 50, "a b c d e f a b c d e f g b c d e f", "l\nl\n\nl \n l\n",
           "\x1c a\x0bb\x0cc\r\nd", "é😀 ß " * 6, "#*$% &|<> !!", "up " * 4 + "\n" + "up " * 4]
    out += [" ".join(rng.choices("abcd", k=rng.randint(1, 60))) for _ in range(80)]
    out += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    return out + ["word%d " % (i % 7) * 3 + "z" for i in range(5)] + [" ".join(f"w{i % 9973}" for i in range(60000))]


def test_counts_brute(spark):
    rows = list(enumerate(samples()))
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in quality.measures(frame(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == brute(t), repr(t)[:100]


def em(patterns, n_rules):
    total = sum(patterns.values())
    c, prior = quality.PSEUDO * total, quality.PRIOR
    good, bad = [quality.ON_GOOD] * n_rules, [quality.ON_BAD] * n_rules
    for _ in range(quality.ROUNDS):
        q = {}
        for v in patterns:
            lg, lb = math.log(prior), math.log(1 - prior)
            for j, x in enumerate(v):
                if x is not None:
                    lg += math.log(good[j] if x else 1 - good[j])
                    lb += math.log(1 - bad[j] if x else bad[j])
            q[v] = 1 / (1 + math.exp(lb - lg))
        prior = (sum(n * q[v] for v, n in patterns.items()) + c * quality.PRIOR) / (total + c)
        good, bad = [
            [(sum(n * wt(v) for v, n in patterns.items() if v[j] == hit) + c * start)
             / (sum(n * wt(v) for v, n in patterns.items() if v[j] is not None) + c) for j in range(n_rules)]
            for wt, hit, start in ((lambda v: q[v], 1, quality.ON_GOOD), (lambda v: 1 - q[v], 0, quality.ON_BAD))]
    return prior, good, bad


def test_estimate_brute(spark):
    rng = random.Random(9)
    votes = [tuple(rng.choice([0, 1, 1, 1, None]) for _ in range(4)) for _ in range(500)]
    patterns = {}
    for v in votes:
        patterns[v] = patterns.get(v, 0) + 1
    got = quality.estimate(spark.createDataFrame([(list(v),) for v in votes], "v array<int>"), 4)
    prior, good, bad = em(patterns, 4)
    assert got["prior"] == pytest.approx(prior) and got["good"] == pytest.approx(good) and got["bad"] == pytest.approx(bad)
    none = quality.estimate(spark.createDataFrame([], "v array<int>"), 4)
    assert none["prior"] == pytest.approx(quality.PRIOR)


def test_estimate_finds_planted_rates(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.85
        rows.append(([int(rng.random() < (0.97 if good else 0.25)) for _ in range(5)],))
    got = quality.estimate(spark.createDataFrame(rows, "v array<int>"), 5)
    assert abs(got["prior"] - 0.85) < 0.03
    assert all(abs(g - 0.97) < 0.02 for g in got["good"]) and all(abs(b - 0.75) < 0.08 for b in got["bad"])


def test_verdicts_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.verdicts(docs).join(labels.withColumnRenamed("doc_id", "id"), "id").where("NOT base_failed")
    clean = rows.where("quality = 1")
    assert clean.where("kept").count() >= 0.99 * clean.count()
    assert rows.where("quality = 0 AND kept").count() <= 0.1 * max(10, rows.where("quality = 0").count())


def test_edges(spark):
    prose = "The of and in a to it is that for on was with as by at from this be are. " * 1
    rows = [(1, None), (2, ""), (3, prose), (3, prose), (None, prose), (None, "short"), (4, "### $$$ " * 30)]
    got = quality.verdicts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.id for r in got if r.kept} == {3, None}
    kept = quality.without_rejects(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("3", prose), ("3", prose), ("None", prose)])
    assert quality.verdicts(frame(spark, [])).count() == 0 and quality.without_rejects(frame(spark, [])).count() == 0


def test_main_path_is_native(spark):
    df = quality.verdicts(frame(spark, [(1, "a b")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert isinstance(F.lit(1), type(quality.posterior({"prior": 0.5, "good": [0.9], "bad": [0.9]})))
