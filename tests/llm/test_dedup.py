import hashlib
import random

import numpy as np
import pytest
import xxhash

from trustloom.llm import exact, hamming, simhash
from trustloom.llm.components import components

DOCS = "doc_id long, text string, lang string, id string, fp string, body string, size int, head int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", 1, 2, 3) for i, t in rows], DOCS)


ROWS = [(1, "a b c"), (2, "a b c"), (3, ""), (4, None), (5, "a b c "), (5, "a b c "), (None, "solo"), (None, "a b c"),
        (9, "x" * 300 + "1"), (8, "x" * 300 + "2"), (7, "x" * 300 + "1"), (10, "long " * 60000)]


def test_copy_groups_brute(spark):
    got = exact.copy_groups(frame(spark, ROWS)).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for i in g)
    assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_copy_groups_without_broadcast(spark, monkeypatch):
    usual = sorted(map(str, exact.copy_groups(frame(spark, ROWS)).collect()))
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 0)
    assert sorted(map(str, exact.copy_groups(frame(spark, ROWS)).collect())) == usual


def test_without_copies(spark):
    out = exact.without_copies(frame(spark, ROWS))
    assert out.columns == frame(spark, []).columns
    assert sorted((r.text or "") for r in out.collect()) == sorted({t or "" for _, t in ROWS})
    assert exact.without_copies(frame(spark, [])).count() == 0
    assert exact.copy_groups(frame(spark, [])).count() == 0


def brute_fp(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", ["", None, " \t", "One", "one TWO", "É a b C d e", "a\x0bb\x0cc\x1cd e f", "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode(), 3) == brute_fp(text)


def test_fingerprint_blocks(monkeypatch):
    text = " ".join(random.Random(5).choices("the of a to in it is that".split(), k=5000))
    monkeypatch.setattr(simhash, "word_blocks", lambda d: (d.split()[i:i + 7] for i in range(0, 5000, 7)))
    assert simhash.fingerprint(text.encode(), 3) == brute_fp(text)


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(n, seed):
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 60])):
            c2 = c
            for _ in range(rng.randint(0, 4)):
                c2 ^= 1 << rng.randrange(64)
            out.add(c2)
    return sorted(out)


def test_node_links_all_pairs():
    fps = clustered(700, 1)
    a, b = hamming.node_links(np.array(fps, np.uint64))
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for j in range(len(fps)) for i in range(j) if bin(fps[i] ^ fps[j]).count("1") <= 2}
    assert got == want and len(a) == len(got)


@pytest.mark.parametrize("node_rows", [4096, 3])
def test_links_and_components(spark, node_rows):
    fps = clustered(500, 2)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(hamming.links(rows, node_rows=node_rows)).collect()}
    mine = [roots.get(f - (1 << 64) if f >> 63 else f, f) for f in fps]
    brute = brute_components(fps)
    pairs = {}
    for m, b in zip(mine, brute):
        assert pairs.setdefault(b, m) == m
    assert len(set(mine)) == len(set(brute))


def test_components_path(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:])) + [(500, 500), (None, 1)], "u long, v long")
    assert {(r.node, r.root) for r in components(df).collect()} == {(i, 0) for i in range(200)}
    assert components(df.where("false")).count() == 0


def test_near_groups(spark):
    rng = random.Random(4)
    base = [rng.choices([f"w{i}" for i in range(500)], k=400) for _ in range(6)]
    rows = []
    for k in range(60):
        w = list(base[k % 6])
        if k % 3:
            w[rng.randrange(400)] = "NEW"
        rows.append((k * 3, " ".join(w)))
    rows += [(1000, None), (1001, ""), (None, "q r"), (None, "Q R"), (50, rows[0][1])]
    got = simhash.near_groups(frame(spark, rows)).collect()
    fps = sorted({brute_fp(t) for _, t in rows})
    label = dict(zip(fps, brute_components(fps)))
    low = {}
    for i, t in rows:
        key = label[brute_fp(t)]
        low[key] = min([x for x in (low.get(key), i) if x is not None], default=None)
    want = sorted((str(i), brute_fp(t), str(low[label[brute_fp(t)]])) for i, t in rows)
    assert sorted((str(r.id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    kept = simhash.without_near_copies(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    stays = {}
    for i, t in rows:  # one document of each group: an id before null, then the smaller hash
        key, doc = label[brute_fp(t)], (i is None, i, hashlib.sha256((t or "").encode()).digest())
        stays[key] = min(doc, stays.get(key, doc), key=lambda d: (d[0], d[1] or 0, d[2]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[1]) for d in stays.values())
    assert simhash.near_groups(frame(spark, [])).count() == 0


def test_digest_is_sha256(spark):
    from pyspark.sql import functions as F
    got = exact.copy_groups(frame(spark, ROWS), carry={"d": F.sha2(F.coalesce("text", F.lit("")), 256)}).collect()
    assert {r.d for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}


def test_near_decisions_with_clashing_columns(spark):
    """Null ids, one id with several texts, repeated rows (one document); texts without words are linked like any other."""
    rows = [(1, "a b c d"), (None, "a b c d"), (2, "something else entirely here"), (2, "a b c d"), (None, "  "), (4, ""),
            (3, "more words that stand alone now"), (3, "more words that stand alone now")]
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _away int, _sha string")
    got = simhash.without_near_copies(docs)
    assert got.columns == docs.columns and sorted(r._away for r in got.collect()) == [0, 2, 5, 6, 7]
