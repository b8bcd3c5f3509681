"""Clustering on the co-review projection (users linked by a common product), without writing the projection.

A product with d users makes d^2 links, so links never leave a task. Users with equal product sets are one node with a
multiplicity: they are linked to each other and to the same others, so a hub's users with nothing else are one node. The
nodes stand in blocks, rare products first, so that blocks with nothing in common are not compared. A task gets three blocks i, j, k
as product sets, makes the links between small sub-blocks as matrices, and adds up for each node of i the linked pairs of its
neighbours in j and k by a matrix product. What leaves a task is one row per node of i.

Where all sets are made of at most ``LATTICE`` products, sums over the lattice of their subsets take the place of the links: the
work is that of the lattice, however many users and sets there are.

With c the multiplicities and N(t) the neighbours of node t, itself included: D = sum of c over N(t), and Q = sum of
c(a) c(b) over the linked pairs a, b in N(t). Then a user of t has D - 1 neighbours and (Q - 3 D + 2) / 2 triangles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trustloom.operators.ordered import attach, row_numbers
from trustloom.session import shard_count, written

LEAST_ROWS, MOST_ROWS, SUB_ROWS, SIDE = 128, 1 << 14, 1024, 6
LATTICE = 20  # products whose subsets a task holds, in LATTICE + 1 tables


def _incidence(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Node, multiplicity, and the (row, product) entries of a block."""
    sets = table["products"].combine_chunks()
    rows = np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy(zero_copy_only=False))
    return table["node"].to_numpy(), table["m"].to_numpy().astype(np.float64), rows, sets.flatten().to_numpy(zero_copy_only=False)


def _parts(block):
    """The block in sub-blocks: first row, rows, and for each product its rows there."""
    node, _, rows, products = block
    for start in range(0, len(node), SUB_ROWS):
        mine = (rows >= start) & (rows < start + SUB_ROWS)
        r, p = rows[mine] - start, products[mine]
        order = np.argsort(p, kind="stable")
        names, first = np.unique(p[order], return_index=True)
        yield start, min(SUB_ROWS, len(node) - start), names, np.split(r[order], first[1:])


def _links(a, b, kind=np.float32) -> np.ndarray:
    """Which rows of two sub-blocks have a product in common."""
    out = np.zeros((a[1], b[1]), kind)
    _, i, j = np.intersect1d(a[2], b[2], assume_unique=True, return_indices=True)
    for x, y in zip(i, j):
        out[np.ix_(a[3][x], b[3][y])] = 1
    return out


def _triples(table: pa.Table) -> pa.Table:
    """``node, d, q`` of the first block's nodes from the pairs of neighbours in the second and third block."""
    i, j, k = (_incidence(table.filter(pa.compute.equal(table["role"], r))) for r in range(3))
    twice, same = (2 if table["j"][0].as_py() < table["k"][0].as_py() else 1), table["j"][0].as_py() == table["k"][0].as_py()
    d, q = np.zeros(len(i[0])), np.zeros(len(i[0]))
    parts_j, parts_k = list(_parts(j)), list(_parts(k))
    # sums of whole numbers are exact in the short type up to 2^24
    kinds = [np.float32 if j[1][b[0]:b[0] + b[1]].sum() <= 1 << 24 else np.float64 for b in parts_j]
    between = {}
    for a in _parts(i):
        to_k = [_links(a, c) * k[1][c[0]:c[0] + c[1]] for c in parts_k]
        at = slice(a[0], a[0] + a[1])
        for x, b in enumerate(parts_j):
            to_j = _links(a, b, kinds[x]) * j[1][b[0]:b[0] + b[1]].astype(kinds[x])
            if same:
                d[at] += to_j.sum(1, dtype=np.float64)
            for y, c in enumerate(parts_k):
                if (x, y) not in between:
                    if len(between) > 16:
                        between.clear()
                    between[x, y] = _links(b, c, kinds[x])
                q[at] += twice * np.einsum("ij,ij->i", to_j @ between[x, y], to_k[y])
    return pa.table({"node": i[0], "d": d, "q": q})


def subset_sums(values: np.ndarray, sign: int = 1) -> np.ndarray:
    """For each set, as a number, the sum of the values of its subsets; with ``sign`` -1 the values of such sums."""
    out = values.copy()
    for bit in range(len(out).bit_length() - 1):
        halves = out.reshape(-1, 2, 1 << bit)
        halves[:, 1] += sign * halves[:, 0]
    return out


def lattice_sums(sets: np.ndarray, m: np.ndarray, products: int) -> tuple[np.ndarray, np.ndarray]:
    """``d, q`` of sets given as numbers with a bit for each product.

    Neighbours that are not linked have disjoint sets, so q is the square of d without the disjoint pairs that both meet the set: all
    disjoint pairs, without those with a first or a second set outside, with those with both.
    """
    every = 1 << products
    count = np.zeros(every, np.int64)
    np.add.at(count, sets, m)
    size = np.bitwise_count(np.arange(every))
    inside = subset_sums(count)
    by_size = [subset_sums(np.where(size == n, count, 0)) for n in range(products + 1)]
    unions = np.zeros(every, np.int64)  # disjoint pairs by what they make together
    for n in range(products + 1):
        made = subset_sums(sum(by_size[i] * by_size[n - i] for i in range(n + 1)), -1)
        unions += np.where(size == n, made, 0)
    both, first = subset_sums(unions), subset_sums(count * inside[::-1])
    rest = every - 1 - sets
    d = inside[-1] - inside[rest]
    return d, d * d - both[-1] + 2 * first[rest] - both[rest]


def _by_lattice(kept: DataFrame, nodes: DataFrame, names: DataFrame, products: int) -> DataFrame:
    """``node, d, q`` where there are few products: at most 2^products rows meet in one task."""
    bits = kept.join(F.broadcast(names), "p").groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set"))

    def work(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is not None:
            d, q = lattice_sums(table["set"].to_numpy(), table["m"].to_numpy(), products)
            yield from pa.table({"node": table["node"], "d": d.astype(np.float64), "q": q.astype(np.float64)}).to_batches()

    return bits.join(nodes.select("node", "m"), "node").coalesce(1).mapInArrow(work, "node long, d double, q double")


def co_review_clustering(df: DataFrame, user: str, product: str, block_rows: int | None = None) -> DataFrame:
    """``user, neighbours, triangles, clustering`` of every user in the graph that links users of a common product.

    Rows without user or product are left out; a user without neighbours has clustering 0. Hubs count whole. With more than
    ``LATTICE`` products, or with ``block_rows``, the sets meet in blocks: the arithmetic grows with the cube of the distinct product
    sets that are linked by blocks, the rows copied with their square times blocks.
    """
    edges = written(df.where(F.col(user).isNotNull() & F.col(product).isNotNull()).select(
        F.col(user).alias("u"), F.col(product).alias("p")).distinct(), "review-edges")
    sets = edges.groupBy("u").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("p")).alias("h1"),
                                  F.bit_xor(F.xxhash64("p", F.lit(1))).alias("h2"))
    sig = ["n", "h1", "h2"]
    nodes = written(sets.groupBy(*sig).agg(F.min("u").alias("u"), F.count("*").alias("m")).withColumn(
        "node", F.monotonically_increasing_id()), "product-sets")
    kept = written(edges.join(nodes.select("u", "node"), "u").select("node", "p"), "node-products")
    few = kept.select("p").distinct().limit(LATTICE + 1).collect()
    if block_rows is None and len(few) <= LATTICE:
        names = df.sparkSession.createDataFrame([(r.p, b) for b, r in enumerate(few)], kept.select("p").withColumn("bit", F.lit(0)).schema)
        sums = _by_lattice(kept, nodes, names, len(few))
    else:
        sums = _by_links(kept, nodes, block_rows)
    links, pairs = F.col("d") - 1, F.col("q") - 3 * F.col("d") + 2
    per_set = written(nodes.join(sums, "node").select(
        *sig, "m", links.cast("bigint").alias("neighbours"), (pairs / 2).cast("bigint").alias("triangles"),
        F.when(links > 1, pairs / (links * (links - 1))).otherwise(F.lit(0.0)).alias("clustering")), "set-clustering")
    out = attach(sets.withColumnRenamed("n", "_n"), per_set.withColumnRenamed("n", "_n"), ["_n", "h1", "h2"], "u", "m")
    return out.select(F.col("u").alias(user), "neighbours", "triangles", "clustering")


def _by_links(kept: DataFrame, nodes: DataFrame, block_rows: int | None) -> DataFrame:
    """``node, d, q`` from blocks of sets: the arithmetic grows with the cube of the sets that are linked by blocks."""
    # products by number, the rarest of a set first
    freq = kept.groupBy("p").agg(F.count("*").alias("f")).withColumn("number", F.xxhash64("p"))
    numbered = attach(kept, freq, "p", "node", "f")
    packed = numbered.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "number"))).alias("s")).select(
        "node", F.transform("s", lambda e: e["number"]).alias("products"), F.col("s")[0]["f"].alias("f"), F.col("s")[0]["number"].alias("first"))
    n = nodes.count()
    size = block_rows or min(MOST_ROWS, max(LEAST_ROWS, math.ceil(n / SIDE)))
    placed = row_numbers(packed.select("node", "f", "first"), [], ["f", "first", "node"])
    blocks = written(packed.select("node", "products").join(nodes.select("node", "m"), "node").join(
        placed.select("node", F.floor((F.col("rn") - 1) / size).cast("int").alias("block")), "node"), "set-blocks")
    # blocks that have a product in common: at most (nodes / size)^2 rows
    has = blocks.select("block", F.explode("products").alias("p")).distinct().groupBy("p").agg(F.collect_list("block").alias("bs"))
    near = written(has.select(F.explode("bs").alias("a"), "bs").select("a", F.explode("bs").alias("b")).distinct(), "linked-blocks")
    pair = lambda x, y: near.select(F.col("a").alias(x), F.col("b").alias(y))
    triples = pair("i", "j").join(pair("i", "k"), "i").where("j <= k").join(pair("j", "k"), ["j", "k"]).select("i", "j", "k")
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("block")) for r, c in enumerate("ijk")]))
    sides = triples.withColumn("e", roles).select("i", "j", "k", "e.role", "e.block").join(blocks, "block")
    met = sides.repartition(shard_count(kept.sparkSession), "i", "j", "k").groupBy("i", "j", "k").applyInArrow(
        lambda t: _triples(t), "node long, d double, q double")
    return met.groupBy("node").agg(F.sum("d").alias("d"), F.sum("q").alias("q"))
