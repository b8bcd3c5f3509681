"""Hamming links between 64-bit fingerprints by a hierarchical index in Gray order.

Upper nodes are masked bit patterns. The first level fixes two of four 16-bit blocks (six masks): two fingerprints that
differ in at most two bits agree on two blocks, so they meet in one of these nodes. A node with more than ``node_rows``
fingerprints is split again by three parts of its free bits (one part must still agree), and once more; after that at
most 15 bits are free, so even the fullest node has at most 2**15 different fingerprints. No fingerprint or link is lost
and no node grows with the data.

Inside a node the fingerprints are sorted by Gray rank, runs of ``LEAF`` become leaves, and leaves are factored into nodes
that hold (mask of shared bits, shared bits). Pairs of nodes whose shared bits already differ too often are pruned as
a whole; only surviving leaf pairs compare fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trustloom.llm.common import dropped, small, stored, width

DISTANCE, LEAF, FAN, NODE_ROWS = 2, 32, 8, 4096
ONES = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(free: int, n: int) -> list[int]:
    """Cut the set bits of ``free`` into ``n`` masks of nearly equal size."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(bits[i * len(bits) // n:(i + 1) * len(bits) // n]) for i in range(n)]


def mask_tree() -> list[dict[int, list[int]]]:
    """For each level, the masks below a mask of the level above (0: the root)."""
    blocks = _parts(ONES, 4)
    levels = [{0: [a | b for a, b in combinations(blocks, 2)]}]
    for _ in range(2):
        above = sorted({m for ms in levels[-1].values() for m in ms})
        levels.append({m: [m | p for p in _parts(ONES & ~m, DISTANCE + 1)] for m in above})
    return levels


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _factor(ones: np.ndarray, bits: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared mask and shared bits of each run of ``fan`` nodes."""
    at = np.arange(0, len(bits), fan)
    every, some = np.bitwise_and.reduceat(bits & ones, at), np.bitwise_or.reduceat(bits & ones, at)
    mask = np.bitwise_and.reduceat(ones, at) & ~(every ^ some)
    return mask, every & mask


def node_links(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the different fingerprints ``fps`` (uint64) within ``distance`` bits."""
    order = np.argsort(gray_rank(fps), kind="stable")
    x, n = fps[order], len(fps)
    levels = [_factor(np.full(n, ONES, np.uint64), x, LEAF)]
    while len(levels[-1][0]) > 1:
        levels.append(_factor(*levels[-1], FAN))
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        mask, bits = levels[depth]
        ok = np.bitwise_count((bits[a] ^ bits[b]) & mask[a] & mask[b]) <= distance
        a, b = a[ok], b[ok]
        if depth:  # every pair of children, each pair once
            k = len(levels[depth - 1][0])
            i, j = np.divmod(np.arange(FAN * FAN), FAN)
            ca, cb = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
            ok = (ca < k) & (cb < k) & (ca <= cb)
            a, b = ca[ok], cb[ok]
    left, right = [], []
    i, j = np.divmod(np.arange(LEAF * LEAF), LEAF)
    for s in range(0, len(a), 2048):
        p, q = (a[s:s + 2048, None] * LEAF + i).ravel(), (b[s:s + 2048, None] * LEAF + j).ravel()
        ok = (p < q) & (q < n)
        p, q = p[ok], q[ok]
        ok = np.bitwise_count(x[p] ^ x[q]) <= distance
        left.append(order[p[ok]])
        right.append(order[q[ok]])
    return np.concatenate(left), np.concatenate(right)


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items, the smallest item it reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _node_stars(mask: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links inside each node; rows come sorted by node."""
    key = fps & mask
    cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
    starts = np.concatenate([[0], cut])
    sizes = np.diff(np.concatenate([starts, [len(fps)]]))
    node = np.repeat(np.arange(len(starts)), sizes)
    a, b = [], []
    tiny = sizes[node] <= LEAF  # a node of one leaf: compare at every shift, all such nodes at once
    at = np.flatnonzero(tiny)
    for shift in range(1, int(sizes[sizes <= LEAF].max(initial=0))):
        i = at[:-shift] if shift else at
        i = i[i + shift < len(fps)]
        i = i[node[i] == node[i + shift]]
        if not len(i):
            break
        ok = np.bitwise_count(fps[i] ^ fps[i + shift]) <= DISTANCE
        a.append(i[ok])
        b.append(i[ok] + shift)
    for k in np.flatnonzero(sizes > LEAF):
        p, q = node_links(fps[starts[k]:starts[k] + sizes[k]])
        a.append(p + starts[k])
        b.append(q + starts[k])
    if not a:
        return fps[:0], fps[:0]
    label = _smallest(len(fps), np.concatenate(a), np.concatenate(b))
    i = np.flatnonzero(label != np.arange(len(fps)))
    return fps[i], fps[label[i]]


def _in_nodes(batches):
    """Arrow batches of (mask, fp), sorted by node, to links; a node cut by a batch border is carried over."""
    rest = np.zeros((2, 0), np.uint64)
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1)])
        rows = np.concatenate([rest, rows], axis=1)
        key = rows[0] & rows[1]
        new = np.flatnonzero((rows[0] != rows[0, -1]) | (key != key[-1])) if rows.shape[1] else []
        end = new[-1] + 1 if len(new) else 0
        if end:
            yield from _edges(rows[:, :end])
        rest = rows[:, end:]
    if rest.shape[1]:
        yield from _edges(rest)


def _edges(rows):
    u, v = _node_stars(rows[0], rows[1])
    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def links(fingerprints: DataFrame, col: str = "fp", *, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links ``u, v`` (bigint bit patterns) that connect the same fingerprints as all pairs within two bits do.

    ``fingerprints`` holds different, non-null values. Every node contributes a spanning star of its own links, never all
    its pairs. An empty table or one without links gives no rows.
    """
    rows, found, made = fingerprints.select(F.col(col).alias("fp"), F.lit(0).cast("long").alias("mask")), None, []
    levels = mask_tree()
    for depth, below in enumerate(levels):
        table = F.create_map(*[F.lit(x) if isinstance(x, int) else x for m, ms in below.items()
                               for x in (_signed(m), F.array(*[F.lit(_signed(k)) for k in ms]))])
        rows = rows.select("fp", F.explode(table[F.col("mask")]).alias("mask")).withColumn("key", F.expr("fp & mask"))
        sizes = stored(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
        made.append(sizes)
        last = depth + 1 == len(levels)
        part = sizes if last else sizes.where(F.col("n") <= node_rows)
        inside = (rows.join(small(part.select("mask", "key"), part.count()), ["mask", "key"], "left_semi")
                  .repartition(width(rows.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")
                  .select("mask", "fp").mapInArrow(_in_nodes, "u long, v long"))
        found = inside if found is None else found.unionByName(inside)
        hot = sizes.where(F.col("n") > node_rows)
        n_hot = 0 if last else hot.count()
        if not n_hot:
            break
        rows = rows.join(small(hot.select("mask", "key"), n_hot), ["mask", "key"], "left_semi").select("fp", "mask")
    out = stored(found.distinct(), "links")
    dropped(*made)
    return out
