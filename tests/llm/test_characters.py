import bz2
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from trustloom.llm import characters as C, kneser as K


def events(text):
    s = [0] * (C.ORDER - 1) + [ord(c) + 1 for c in text or ""] + [0]
    return [tuple(s[i:i + C.ORDER]) for i in range(len(s) - C.ORDER + 1)]


class Brute:
    """Interpolated modified Kneser-Ney over whole characters from its definition; ``known`` characters and one unknown one."""

    def __init__(self, texts, known):
        self.base, self.c, self.d, self.by = 1 / (known + 1), {}, {}, {}
        self.c[C.ORDER] = Counter(g for t in texts for g in events(t))
        for n in range(C.ORDER - 1, 0, -1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        for n, c in self.c.items():
            k = Counter(c.values())
            self.d[n], self.by[n] = C.discounts(*[k[i] for i in (1, 2, 3, 4)]), {}
            for g, x in c.items():
                self.by[n].setdefault(g[:-1], []).append(x)

    def p(self, g):
        if not g:
            return self.base
        n, lower = len(g), self.p(g[1:])
        seen = self.by[n].get(g[:-1])
        if not seen:
            return lower
        x, cut = self.c[n][g], sum(self.d[n][min(x, 3) - 1] for x in seen)
        return ((x - self.d[n][min(x, 3) - 1] if x else 0) + cut * lower) / sum(seen)

    def bits(self, text):
        return -sum(math.log2(self.p(g)) for g in events(text)) / len(events(text))


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "And", "ère", "is.", "日本", "42", "😀"]) for _ in range(n))


def test_scores_brute(spark):
    rng = random.Random(3)
    rows = [(i, "en", prose(rng, 25), (0, 1, None)[i % 3]) for i in range(30)]
    rows += [(30, None, None, None), (31, "en", "", 0), (32, "en", "zz ## 語 ￿\0", None), (None, "xx", "of", 1), (3, "en", "of", None)]
    got = C.scores(spark.createDataFrame(rows, "id long, lang string, body string, half int")).collect()
    halves = [[t for _, _, t, h in rows if h == k] for k in (0, 1)]
    known = len({g[-1] for t in halves[0] + halves[1] for g in events(t)})
    models = {0: Brute(halves[1], known), 1: Brute(halves[0], known), None: Brute(halves[0] + halves[1], known)}
    want = sorted((str(i), str(lang), len(t or "") + 1, h is not None, models[h].bits(t)) for i, lang, t, h in rows)
    have = sorted((str(r.id), str(r.lang), r.n_events, r.good, r.bits) for r in got)
    assert [x[:4] for x in have] == [x[:4] for x in want]
    assert np.allclose([x[4] for x in have], [x[4] for x in want], atol=6e-4)


def test_letters_of_one_script_are_told_apart(spark):
    """Han letters in another order are other text: they were one class, so both scored alike."""
    rows = [(i, "日本語の文" * 12 + "日本"[:i % 3], "ja") for i in range(40)] + [(100, "語文本日の" * 12, "ja")]
    trusted = spark.createDataFrame([(i,) for i in range(30)], "_trusted long")
    kept = {r.id: r.kept for r in K.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), trusted).collect()}
    assert not kept[100] and all(kept[i] for i in range(30, 40))


def test_grams_in_steps(monkeypatch):
    texts = ["", "a", "日本" * 9, "x" * 14, "", "the end"]
    want = [(k, g) for k, t in enumerate(texts) for g in events(t)]
    for step in (5, 7, 1000):
        monkeypatch.setattr(C, "STEP", step)
        got = []
        for hi, lo, owner in C.grams(texts):
            got += [(k, (h >> 21, h & 0x1FFFFF, x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF))
                    for h, x, k in zip(hi.tolist(), lo.tolist(), owner.tolist())]
        assert got == want


def test_discounts_leave_something():
    assert C.discounts(0, 0, 0, 0) == (0.5, 0.5, 0.5)
    assert min(C.discounts(1, 5, 20, 40)) > 0


def test_texts_unpacked_in_steps(monkeypatch):
    for texts in ([""], ["", "a", "", "日本😀" * 9, "x" * 14, ""], ["long " * 100, "é"]):
        data = [t.encode() for t in texts]
        for step in (1, 7, 1 << 20):
            monkeypatch.setattr(C, "STEP", step)
            assert [*C._unpacked(bz2.compress(b"".join(data)), [len(d) for d in data])] == texts


def test_counts_over_many_steps(monkeypatch):
    rng = random.Random(5)
    texts, half = [prose(rng, 40) for _ in range(60)], np.array([0, 1, 2] * 20, np.uint8)
    monkeypatch.setattr(C, "STEP", 100)
    hi, lo, n = C._counted(texts, half)
    assert (np.lexsort((lo, hi)) == np.arange(len(hi))).all()
    want = Counter((int(h), g) for t, h in zip(texts, half) for g in events(t))
    got = {(k, (a >> 21, a & 0x1FFFFF, b >> 42, b >> 21 & 0x1FFFFF, b & 0x1FFFFF)): n[k, i]
           for i, (a, b) in enumerate(zip(hi.tolist(), lo.tolist())) for k in range(3) if n[k, i]}
    assert got == want


def test_memory_of_a_block(spark, monkeypatch):
    """A block's text was held as one string and its bytes: 7.9 bytes a character here, without what Arrow holds."""
    rng = random.Random(6)
    rows = [(i, "en", prose(rng, 700), (0, 1, None)[i % 3]) for i in range(800)]
    table = C.blocks(spark.createDataFrame(rows, "id long, lang string, body string, half int").coalesce(1)).toArrow()
    block = table.filter(pa.compute.equal(table["part"], 0)).select(["block", "ids", "langs", "body"])
    place = np.zeros(len(table) - 1, np.uint32)
    place[1:] = 1
    values = pa.table({"answers": [C.pack(place, *[np.full(len(place), x, np.float32) for x in (2, 3, 4)])]})
    monkeypatch.setattr(C, "STEP", 1 << 15)
    chars = sum(len(t) for _, _, t, _ in rows)
    tracemalloc.start()
    try:
        got = C._scored(block, values)
        assert tracemalloc.get_traced_memory()[1] < 4 * chars
    finally:
        tracemalloc.stop()
    assert got["n_events"].to_pylist() == [len(t) + 1 for _, _, t, _ in rows]
    assert got["bits"].to_pylist() == [(3.0, 2.0, 4.0)[i % 3] for i in range(800)]
