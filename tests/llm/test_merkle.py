import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trustloom.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """Root and every leaf's siblings (side, digest) by plain pairing."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, owners = [], []
        for k in range(0, len(nodes), 2):
            pair = nodes[k:k + 2]
            for side, mine in enumerate(owner[k:k + 2]):
                step = ("-", "0" * 64) if len(pair) == 1 else ("RL"[side], pair[1 - side])
                for i in mine:
                    paths[i].append(step)
            up.append(sha(*pair))
            owners.append(sum(owner[k:k + 2], []))
        nodes, owner = up, owners
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([h for _, h in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order}
    root, tops = climb([trees[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        rows_of = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        out += [(i, h, trees[g][0], root, path + tops[k]) for (i, h), path in zip(rows_of, trees[g][1])]
    return out


def check(got, rows):
    show = lambda x: (str(x[0]), x[1], x[2], x[3], [tuple(s) for s in x[4]])
    assert sorted(show((r.id, r.leaf, r.subroot, r.root, r.path)) for r in got) == sorted(map(show, brute(rows)))


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_is_that_of_plain_pairing(spark, monkeypatch, levels):
    """A hot group, groups of 1, 2, 3 and a null group; null ids and values, repeated rows, one id with two texts."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rng = random.Random(1)
    rows = [(i, f"s{i % 3}", "en", rng.randrange(99), "wörd " * rng.randrange(40)) for i in range(75)]
    rows += [(100, "s", "de", 1, "x"), (101, None, "fr", None, ""), (102, "s", "fr", 3, None), (103, "s", "Zz", 3, "a"),
             (104, "s", "Zz", 3, "b"), (105, "s", "Zz", 3, "c"), (106, "s", None, 3, "d"), (None, "s", None, 3, "e"),
             (None, None, None, None, None), (7, "s1", "en", 1, "again"), (104, "s", "Zz", 3, "b"), (104, "s", "Zz", 3, "b")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(df.withColumns({"pos": F.lit(1), "grp": F.lit("x"), "leaf": F.lit("y")}), COLUMNS).collect()
    check(got, rows)
    for r in got:
        assert r.root == got[0].root


def test_many_groups_and_small_tables(spark):
    rows = [(i, "s", f"lang{i * 7 % 37}", 1, "t") for i in range(60)]
    check(merkle.manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS).collect(), rows)
    one = merkle.manifest(spark.createDataFrame(rows[:1], SCHEMA), COLUMNS).first()
    assert one.leaf == one.subroot == one.root == leaf(rows[0]) and one.path == []
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), COLUMNS).count() == 0


def test_fold_finds_a_changed_leaf(spark):
    rows = [(i, "s", "en" if i % 3 else None, i, "t" * i) for i in range(21)]
    changed = F.when(F.col("doc_id") % 2 == 0, merkle.leaf_hash(["doc_id", "source", "lang", F.col("n_chars") + 1, "text"]))
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS, carry={"changed": changed})
    got = got.withColumns({"same": merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"),
                           "other": merkle.fold(F.col("changed"), F.col("path")) == F.col("root")}).collect()
    assert all(r.same for r in got) and {(r.id % 2, r.other) for r in got} == {(0, False), (1, None)}
