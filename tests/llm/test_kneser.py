import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.llm import kneser as K

DOCS = "doc_id long, text string, lang string, id string, bits string, n_events int, own int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "a", "b", 1, 2) for i, t, lang in rows], DOCS)


def classes(text):
    return [K._class(c) if ord(c) < 0x10000 else K.REST for c in text or ""]


class Brute:
    """Interpolated modified Kneser-Ney from its definition, over tuples."""

    def __init__(self, texts):
        top = Counter()
        for t in texts:
            s = [K.EDGE] * (K.ORDER - 1) + classes(t) + [K.EDGE]
            top.update(tuple(s[i:i + K.ORDER]) for i in range(len(s) - K.ORDER + 1))
        self.c = {K.ORDER: top}
        for n in range(K.ORDER - 1, 0, -1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d, self.by = {}, {}
        for n, c in self.c.items():
            k = Counter(c.values())
            self.d[n] = K.discounts(*[k[i] for i in (1, 2, 3, 4)])
            self.by[n] = {}
            for g, x in c.items():
                self.by[n].setdefault(g[:-1], []).append(x)

    def p(self, g):
        n = len(g)
        if not n:
            return 1 / K.CLASSES
        lower = self.p(g[1:])
        seen = self.by[n].get(g[:-1])
        if not seen:
            return lower
        cut = [self.d[n][min(x, 3) - 1] for x in seen]
        x = self.c[n][g]
        own = x - self.d[n][min(x, 3) - 1] if x else 0
        return own / sum(seen) + sum(cut) / sum(seen) * lower

    def bits(self, text):
        s = [K.EDGE] * (K.ORDER - 1) + classes(text) + [K.EDGE]
        events = [tuple(s[i:i + K.ORDER]) for i in range(len(s) - K.ORDER + 1)]
        return -sum(math.log2(self.p(g)) for g in events) / len(events)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "And", "tion", "ère", "is.", "to,", "42"]) for _ in range(n))


def test_model_brute(spark):
    rng = random.Random(2)
    texts = [prose(rng, 30) for _ in range(20)] + ["", None, "a\nb"]
    p = K.probabilities(K.counts(spark.createDataFrame([(t,) for t in texts], "text string")))
    assert np.allclose(p.reshape(-1, K.CLASSES).sum(1), 1)
    brute = Brute(texts)
    rows = [(i, t, "en") for i, t in enumerate([*texts[:5], "zz ## 日本 😀", "", None, "THE!! of", "x" * 50])]
    got = {r.id: r for r in K.scores(frame(spark, rows), p).collect()}
    for i, t, _ in rows:
        assert got[i].bits == pytest.approx(brute.bits(t), abs=2e-3)
        assert got[i].n_events == len(t or "") + 1


def test_blocks(monkeypatch):
    text = prose(random.Random(1), 200)
    whole = np.concatenate(list(K.grams(text)))
    monkeypatch.setattr(K, "BLOCK", 7)
    assert (np.concatenate(list(K.grams(text))) == whole).all() and len(whole) == len(text) + 1
    assert [len(x) for x in K.grams("x" * 14)] == [7, 8]


def test_classify_edges(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40), "en") for i in range(40)]
    rows += [(100, "### $$$ %%% " * 20, "en"), (101, None, "xx"), (102, prose(rng, 40), None), (None, "@@@@ ####", "en"),
             (5, rows[5][1], "en"), (103, "日本" * 50, "zz")]
    trusted = spark.createDataFrame([(i,) for i in range(30)], "_trusted long")
    got = K.classify(frame(spark, rows), trusted).collect()
    assert len(got) == len(rows)
    kept = Counter(str(r.id) for r in got if r.kept)
    assert kept["5"] == 2 and not kept["100"] and not kept["103"] and kept["102"] and not kept["None"]
    out = K.without_rejects(frame(spark, rows), trusted)
    assert out.columns == frame(spark, []).columns
    assert Counter(str(r.doc_id) for r in out.collect()) == kept  # the rejected row without an id goes as well
    nobody = K.classify(frame(spark, rows), trusted.where("false"))
    assert nobody.where("NOT kept").count() == 0
    assert K.classify(frame(spark, []), trusted).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trusted = K.trusted_ids(labels).where("_trusted % 2 = 0")
    held = K.classify(docs, trusted).join(labels.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "id"), "id")
    good, odd = held.where("quality = 1"), held.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert odd.where("NOT kept").count() >= 0.5 * odd.count()


def test_quantile_is_per_language(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30), "en") for i in range(20)] + [(50 + i, "日本語" * 9 + str(i), "ja") for i in range(20)]
    trusted = spark.createDataFrame([(i,) for i in [*range(20), *range(50, 70)]], "_trusted long")
    r = K.classify(frame(spark, rows), trusted, quantile=0.5, slack=1.0)
    kept = {x.lang: x.k for x in r.groupBy("lang").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert 0.45 <= kept["en"] <= 0.6 and 0.45 <= kept["ja"] <= 1.0


def test_held_out_accuracy_large(spark):
    """The quantile itself is the limit: most bad documents go, and of good ones unseen by the model few do."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    trusted = K.trusted_ids(labels).where("_trusted % 2 = 0")
    held = K.classify(docs, trusted).join(labels.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "id"), "id")
    n = {(r.quality, r.kept): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    print(n)
    assert n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
