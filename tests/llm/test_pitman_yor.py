import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trustloom.llm import pitman_yor as P

DOCS = "doc_id long, text string, id string, kind int, block string, payload string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", "c") for i, t in rows], DOCS)


def words(text):
    return (text or "").encode().lower().split() + [b""]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w, t = "a", []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(["the", "of", "cat", "dog", "ran."] if w[-1] in "ae" else ["a", "house", "mouse", f"rare{rng.randint(0, 99)}"])
            t.append(w)
        out.append((i, " ".join(t)))
    return out + [(500, None), (501, ""), (502, " \t\n"), (None, "The CAT"), (7, "the dog"), (503, "É é \x1c")]


def test_base_exact(spark):
    rows = corpus()
    got = P.score(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    train = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in rows:
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words(t))
        want[(i, held(i), len(words(t)), sum(train[w] > 0 for w in words(t)), n, round(base, 6))] += 1
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def gibbs(train, unseen, rounds, burn, seed=0):
    """Averaged predictions of a customer-by-customer sampler with explicit tables, for every context and word."""
    rng = random.Random(seed)
    data = []
    for t in train:
        before = 0
        for w in t:
            data.append((before, w))
            before = P.context_class(w)
    vocab = sorted({w for _, w in data})
    c = Counter(data)
    d1 = P._discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    types = Counter(w for _, w in c)
    d0 = P._discount(sum(x == 1 for x in types.values()), sum(x == 2 for x in types.values()))
    tables, parent = defaultdict(list), defaultdict(list)  # customers per table

    def prob_parent(w):
        n, k = sum(map(sum, parent.values())), sum(map(len, parent.values()))
        return (sum(parent[w]) - d0 * len(parent[w]) + (1 + d0 * k) / (len(vocab) + 1)) / (1 + n)

    def prob(u, w):
        n = sum(sum(tables[u, x]) for x in vocab)
        k = sum(len(tables[u, x]) for x in vocab)
        return (sum(tables[u, w]) - d1 * len(tables[u, w]) + (1 + d1 * k) * prob_parent(w)) / (1 + n)

    def add(lst, d, fresh):
        i = rng.choices(range(len(lst) + 1), [x - d for x in lst] + [fresh])[0]
        if i == len(lst):
            lst.append(1)
            return True
        lst[i] += 1
        return False

    def remove(lst):
        i = rng.choices(range(len(lst)), lst)[0]
        lst[i] -= 1
        if not lst[i]:
            del lst[i]
            return True
        return False

    def sit(u, w):
        k = sum(len(tables[u, x]) for x in vocab)
        if add(tables[u, w], d1, (1 + d1 * k) * prob_parent(w)):
            k0 = sum(map(len, parent.values()))
            add(parent[w], d0, (1 + d0 * k0) / (len(vocab) + 1))

    for u, w in data:
        sit(u, w)
    total, keys = Counter(), [(u, w) for u in {P.context_class(w) for w in [*vocab, unseen]} for w in [*vocab, unseen]]
    for r in range(rounds):
        for u, w in data:
            if remove(tables[u, w]):
                remove(parent[w])
            sit(u, w)
        if r >= burn:
            for u, w in keys:
                total[u, w] += prob(u, w) / (rounds - burn)
    return total


def test_predictions_near_exact_sampler(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["xa", "xb", "yc", "yd", "ze"], [8, 4, 3, 1, 1], k=8)) for _ in range(8)]
    ids = [i for i in range(100) if not held(i)][:8]
    slow = gibbs([words(t) for t in texts], b"new", 60, 15)
    queries = [i for i in range(100, 400) if held(i)][:6]
    probes = ["xa", "yd", "new", "xa xb", "ze new", "yc xa xa"]
    got = {r.id: r.score for r in P.score(frame(spark, [*zip(ids, texts), *zip(queries, probes)]), burn_in=4, samples=12).collect()}
    for i, t in zip(queries, probes):
        want, before = 0.0, 0
        for w in words(t):
            want += math.log10(slow[before, w])
            before = P.context_class(w)
        assert got[i] == pytest.approx(want, abs=0.12 * len(words(t)))


def test_normalised_state():
    """Over all words of a small bucket the averaged prediction of a context sums to one."""
    text = [(b"", 3), (b"aa", 5), (b"bb", 1), (b"cc", 40)]
    per = np.full(4, 2, np.uint16)
    ctx = np.array([1, 2] * 4, np.uint16)
    c = np.array([x for _, n in text for x in (n, n + 1)], np.uint32)
    payload = P.pack(b" ".join(w for w, _ in text), per, ctx, c, np.ones(8, np.uint32), np.zeros(8), np.ones(4, np.uint32), np.zeros(4))

    def sums(p):
        _, per, ctx, c, t, _, r, _ = P.unpack(p, P.STATE)
        return {"c": np.bincount(ctx, c, P.CONTEXTS), "t": np.bincount(ctx, t, P.CONTEXTS), "words": 4.0,
                "parent": float(t.sum()), "parent_tables": float(r.sum())}

    back, unknown = np.zeros(P.CONTEXTS), 0.0
    for k in range(5):
        s = sums(payload)
        back += (1 + 0.6 * s["t"]) / (1 + s["c"]) / 5
        unknown += float(P._parent(0, 0, s, 0.5)) / 5
        payload = P.sweep(payload, s, 0.5, 0.6, True, True, (k,))
    _, _, ctx, _, t, own, r, up = P.unpack(payload, P.STATE)
    for u in (1, 2):
        assert own[ctx == u].sum() / 5 + back[u] * (up.sum() / 5 + unknown) == pytest.approx(1, abs=1e-6)
    assert (t >= 1).all() and (r >= 1).all()


def test_seating_matches_one_by_one():
    rng = np.random.default_rng(1)
    for c, new, step, d in ((1, 2.0, 0.1, 0.5), (7, 0.4, 0.0, 0.6), (300, 5.0, 0.2, 0.7), (5000, 1.0, 0.01, 0.3)):
        many = P.seat(rng, np.full(400, c), np.full(400, new), np.full(400, step), d)
        slow = []
        for _ in range(60):
            t = 1
            for i in range(1, c):
                f = new + step * t
                t += rng.random() < f / (f + max(i - d * t, 0))
            slow.append(t)
        assert many.mean() == pytest.approx(np.mean(slow), rel=0.1)
        assert many.min() >= 1 and many.max() <= c


def test_blocks_and_edges(spark, monkeypatch):
    rows = corpus(40, 3)
    usual = sorted((str(r.id), round(r.base_score, 6)) for r in P.score(frame(spark, rows)).collect())
    monkeypatch.setattr(P, "BLOCK", 50)
    assert sorted((str(r.id), round(r.base_score, 6)) for r in P.score(frame(spark, rows).coalesce(1)).collect()) == usual
    assert P.score(frame(spark, [])).count() == 0
    only = [i for i in range(50) if held(i)][:2]
    for r in P.score(frame(spark, [(i, "a b") for i in only])).collect():
        assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.base_score == 0 and abs(r.score) < 1e-9


def test_restaurants_are_whole_words(spark):
    """Words of one ending are different contexts."""
    ids = [i for i in range(200) if not held(i)]
    rows = [(i, "cat sleeps" if k % 2 else "bat flies") for k, i in enumerate(ids)]
    out = [i for i in range(200, 300) if held(i)][:4]
    probes = dict(zip(out, ["cat sleeps", "bat flies", "cat flies", "bat sleeps"]))
    got = {probes[r.id]: r.score for r in P.score(frame(spark, [*rows, *probes.items()])).collect() if r.id in probes}
    assert min(got["cat sleeps"], got["bat flies"]) > max(got["cat flies"], got["bat sleeps"]) + 1


def test_packed_parts():
    parts = [b"ab", np.array([1, 70_000, 3], np.uint64), np.array([255], np.uint32), np.array([0.5, -2.0]), np.zeros(0, np.uint32)]
    got = P.unpack(P.pack(*parts), "b u8 u4 f8 u4")
    assert got[0] == b"ab" and all((a == b).all() and a.dtype == b.dtype for a, b in zip(got[1:], parts[1:]))
