import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "lang string, source string, text string"


def brute(rows, min_docs=10, top=10):
    docs = [(a or "", b or "", TERM.findall((t or "").translate(UPPER))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {w for d in mine for w in d[2]}
        kept = {w for w in kept if sum(w in d[2] for d in mine) >= min_docs}

        def shares(some):
            n = {w: sum(d[2].count(w) for d in some) for w in kept}
            return n, {w: 1 + 10**9 * (c + 2) // (sum(n.values()) + 2 * len(kept)) for w, c in n.items()}

        f = lambda p, q: (p - q) * (p - q) // (p + q)
        _, whole = shares(mine)
        groups = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (n, p) in groups.items():
            pairs = [(-sum(f(p[w], q[w]) for w in kept), o.encode()) for o, (_, q) in groups.items() if o != s]
            terms = [(-f(p[w], whole[w]), w.encode()) for w in kept if n[w] and p[w] > whole[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, o.decode(), -v, k + 1) for k, (v, o) in enumerate(found)]
    return sorted(out)


def documents(seed):
    """A hot source, a source without terms, null columns, repeated rows, words beyond ASCII, copies."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "délta", "Éta", "zeta7eta", "x-y", "naïve", "你好", "wörd"] + [f"w{chr(97 + i)}" for i in range(12)]
    rows = []
    for i in range(120):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", None])
        rows.append((rng.choice(["en", "en", "de", None]), source, " ".join(rng.choices(words[: 4 + i % 18], k=rng.randrange(30)))))
    return rows + [("en", "empty", "12 34 !"), ("en", "none", None), ("xx", "lone", "one two"), ("yy", "p", "q"), ("yy", "r", "")] + rows[:9]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_is_exact(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "CELLS", 8 if seed == 2 else 1 << 18)
    rows = documents(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.lit(1), "term": F.lit("t"), "n": F.lit(2)})
    got = divergence.divergence(df.repartition(3), min_docs=5, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4)


def test_nodes_are_shared():
    """Rows with a common beginning share nodes: sums are those of all rows, from fewer combinations."""
    rng = np.random.default_rng(1)
    rows = sorted(tuple((a, int(rng.integers(1, 3))) for a in range(5) if rng.random() < 0.7) for _ in range(200))
    rows = [r for r in rows if r]
    at, p = (np.array([[e[i] for e in r] + [-1] * (5 - len(r)) for r in rows]) for i in (0, 1))
    m = rng.integers(1, 9, len(rows))
    p, p0 = np.where(at >= 0, p * 1000, -1), np.where(at >= 0, 7 + at, -1)
    f = lambda x, y: (x - y) * (x - y) // (x + y)
    want = {}
    for r in range(len(rows)):
        for k in range(len(rows[r])):
            for b in range(k):
                x, y, x0, y0 = (int(v) for v in (p[r, k], p[r, b], p0[r, k], p0[r, b]))
                key = (int(at[r, k]), int(at[r, b]))
                want[key] = want.get(key, 0) + int(m[r]) * (f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0))
    keys, values = divergence._nodes(at, p, p0, m)
    assert {(k >> 32, k & 0xFFFFFFFF): v for k, v in zip(keys.tolist(), values.tolist())} == want


def test_long_texts_and_blocks(spark):
    """Texts longer than a block are read in pieces; a block of several texts counts each text once for a term."""
    rows = documents(3) + [("en", "long", "alpha Beta " * 400)]
    texts = spark.createDataFrame(rows, SCHEMA).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    want = sorted(map(tuple, divergence.term_counts(texts).collect()))
    cut = texts.mapInArrow(lambda b: divergence._counted(b, 64), "lang string, source string, term string, n long, docs long")
    got = cut.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()
    assert sorted(map(tuple, got)) == want


def test_nothing_kept_and_nothing_there(spark):
    rows = [("en", s, "only rare words here") for s in ("a", "b")]
    assert sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_of_large_counts(spark):
    """Counts at which ten to the ninth times the count leaves 64 bits."""
    n, total, terms = 9_000_000_000_000_000, 9_100_000_000_000_000_000, 123_456
    row = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(terms).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * terms)
