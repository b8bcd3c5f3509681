import itertools
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trustloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = open(PATH).read()


def texts():
    rng = random.Random(3)
    out = ["", None, " ", "a", "a  b", " \n x", "x\n\ny z ", "don't  'll we're", "<|endoftext|> a<|endoftext|>", "\x1c \x1c a", "  b",
           "日本 😀 é", "1234 5678", "tab\t x", "\r\n \r\n", "　 a　 b"]
    out += ["".join(rng.choices("aàb1'.,  \n\t\x1c ", k=rng.randint(1, 30))) for _ in range(200)]
    out += [" ".join(rng.choices(["the", "of", "and,", "tion\n", "x1"], k=rng.choice([50, 900, 1023, 1024, 2600]))) for _ in range(12)]
    return out


def test_pieces_as_library(spark):
    tok = Tokenizer.from_file(PATH)
    rows = [(i, t, 1, "c", 2) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, ids string, length int")
    got = {}
    for r in packing.token_pieces(df, SPEC).collect():
        got.setdefault(r.id, []).append(r)
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(got[i], key=lambda r: r.piece)
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == want, repr(t)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert [p.start for p in parts] == list(itertools.accumulate([0] + [p.length for p in parts[:-1]]))
        assert all(p.length == 1024 for p in parts[1:]) and len(parts) == -(-len(want) // 1024)


def least(items, size):
    """Fewest sequences, by search over all placements."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= size and bins[j] not in bins[:j]:
                go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1:])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def check_plan(plan, counts, size):
    seen = np.zeros_like(counts)
    for filling, n in plan:
        assert n > 0 and 0 < sum(filling) <= size
        for x in filling:
            seen[x] += n
    assert (seen == counts).all()


def test_plan_brute():
    rng = random.Random(11)
    for _ in range(150):
        size = rng.choice([10, 20, 30])
        items = sorted((rng.randint(1, size) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(items, minlength=size + 1)
        plan = packing.bin_completion(counts, size)
        check_plan(plan, counts, size)
        assert sum(n for _, n in plan) == least(items, size), items
        check_plan(packing.best_fit(counts, size), counts, size)


def test_completion_beats_best_fit():
    rng = random.Random(2)
    gains = 0
    for _ in range(300):
        items = [rng.randint(2, 14) for _ in range(24)]
        counts = np.bincount(items, minlength=21)
        a, b = packing.best_fit(counts, 20), packing.bin_completion(counts, 20)
        check_plan(b, counts, 20)
        assert sum(n for _, n in b) <= sum(n for _, n in a)
        gains += sum(n for _, n in b) < sum(n for _, n in a)
    assert gains


def test_large_histogram():
    rng = np.random.default_rng(5)
    counts = np.bincount(np.clip(rng.lognormal(5.5, 1, 300_000).astype(int), 1, 1024), minlength=1025)
    plan = packing.bin_completion(counts, 1024)
    check_plan(plan, counts, 1024)
    total = (counts * np.arange(1025)).sum()
    assert sum(n for _, n in plan) <= -(-total // 1024) * 1.001 + 1


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_pack(spark, n):
    df = spark.range(n, numPartitions=5).select("id", F.lit("x").alias("n"), (F.pmod(F.hash("id"), F.lit(700)) + 1).cast("long").alias("length"))
    if n > 1:
        df = df.withColumn("length", F.when(F.col("id") % 3 == 0, 600).otherwise(F.col("length")))
    rows = packing.pack(df).collect()
    assert len(rows) == n and {"id", "n", "length"} <= set(packing.pack(df).columns)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) >= sum(r.length for r in rows) / 1024
    assert sorted(r.id for r in rows) == list(range(n))


def test_pack_refuses_bad_lengths(spark):
    for bad in (0, 1025, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(bad,)], "length long"))


def test_digest(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = packing.token_pieces(df, SPEC).withColumn("c", F.crc32("ids")).first()
    ids = [*Tokenizer.from_file(PATH).encode("a b", add_special_tokens=False).ids, 2]
    assert r.c == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert json.loads(SPEC)["model"]["type"] == "BPE"


def test_memo_keeps_what_is_frequent(monkeypatch):
    """Rare parts push each other out; a part that comes again and again is encoded once, whatever mark follows."""
    monkeypatch.setattr(packing, "MEMO", 20)
    asked = []
    ids = packing._Ids(lambda text: text.encode(), lambda lead, word: asked.append(word) or (lead + word).encode())
    for i in range(200):
        rare = "".join(chr(97 + int(d)) for d in str(i)) + "zz"
        assert ids["often"] == b" often" and ids["often,"][:6] == b" often" and ids[rare] == b" " + rare.encode()
    assert asked.count("often") == 1 and len(ids) + len(ids.old) <= 20


def test_checksums_stand_for_ids(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = packing.token_pieces(df, SPEC).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    short = packing.token_pieces(df, SPEC, checksums=True)
    assert short.schema == whole.schema and sorted(short.collect()) == sorted(whole.collect())
    assert packing.token_pieces(df.where("false"), SPEC, checksums=True).count() == 0
