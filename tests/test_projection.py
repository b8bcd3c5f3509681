import random

import pytest

from trustloom.operators import projection


def brute(rows):
    products = {}
    for u, p in rows:
        if u is not None and p is not None:
            products.setdefault(u, set()).add(p)
    links = {u: {v for v, q in products.items() if v != u and q & s} for u, s in products.items()}
    out = {}
    for u, near in links.items():
        t, d = sum(len(links[v] & near) for v in near) // 2, len(near)
        out[u] = (d, t, 2 * t / (d * (d - 1)) if d > 1 else 0.0)
    return out


@pytest.mark.parametrize("block_rows", [None, 7])
def test_clustering_on_the_projection(spark, monkeypatch, block_rows):
    """A hub product whose users mostly have nothing else, small circles, users alone, repeated and empty rows."""
    monkeypatch.setattr(projection, "SUB_ROWS", 4)
    rng = random.Random(5)
    rows = [(f"u{i}", "hub") for i in range(60)] + [(f"u{i}", f"p{rng.randrange(12)}") for i in range(40, 110)]
    rows += [(f"u{i}", f"q{i // 3}") for i in range(100, 140)] + [("lone", "only"), ("u1", "hub"), (None, "hub"), ("u2", None)]
    df = spark.createDataFrame(rows, "user string, product string")
    got = {r.user: (r.neighbours, r.triangles, r.clustering) for r in projection.co_review_clustering(df, "user", "product", block_rows).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and any(t for _, t, _ in want.values())
    for u, (d, t, c) in want.items():
        assert got[u][:2] == (d, t) and got[u][2] == pytest.approx(c)


def test_empty_graph(spark):
    assert projection.co_review_clustering(spark.createDataFrame([], "user string, product string"), "user", "product").count() == 0


def test_few_products_need_no_links(spark, monkeypatch):
    """Up to a number of products the work is that of their subsets; one more, and sets meet in blocks again."""
    rng = random.Random(8)
    rows = [(f"u{i}", f"p{p}") for i in range(150) for p in rng.sample(range(7), rng.choice((1, 1, 2, 3, 5)))] + [(None, "p9"), ("u1", None)]
    df = spark.createDataFrame(rows, "user string, product string")
    want, used = brute(rows), []
    monkeypatch.setattr(projection, "_by_lattice", lambda *a, f=projection._by_lattice: used.append("lattice") or f(*a))
    monkeypatch.setattr(projection, "_by_links", lambda *a, f=projection._by_links: used.append("links") or f(*a))
    for most in (7, 6):
        monkeypatch.setattr(projection, "LATTICE", most)
        got = {r.user: (r.neighbours, r.triangles, r.clustering) for r in projection.co_review_clustering(df, "user", "product").collect()}
        assert got.keys() == want.keys()
        for u, (d, t, c) in want.items():
            assert got[u][:2] == (d, t) and got[u][2] == pytest.approx(c)
    assert used == ["lattice", "links"]
