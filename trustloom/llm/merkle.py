"""Merkle manifest of a table: a tree per group, a tree over the groups, and a proof for every row by pointer jumping.

Rows are leaves. Leaves of a group stand in the order of their id; every two consecutive nodes become their hash until one
is left, the group's root. The groups' roots are the leaves of one more tree. A node that has no neighbour in its pair is
hashed alone. Every level of a tree is made in one task a block of ``2 ** BLOCK_LEVELS`` consecutive leaves at most, so a hot
group is cut by positions.

Proofs: every node starts with a pointer to its parent and the one sibling on that way (its segment). A round joins the table
of nodes with itself: the pointer of a node becomes the pointer of the node that it points to, and that node's segment is
put behind its own. So the distance doubles, and a tree of depth d takes log2(d) rounds. Nodes that no leaf can
reach by jumps of the next length are left out, which makes the right side of round r smaller than leaves / 2^(2^r - 1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trustloom.llm.common import dropped, small_bytes, stored, width

BLOCK_LEVELS = 10
# One step of a segment: a side and the sibling's digest. LEFT: the sibling comes first; ALONE: there is none.
LEFT, RIGHT, ALONE = "L", "R", "-"
STEP = 33
_TOP = -1  # group number of the tree over the groups


def leaf_hash(columns: Sequence[str | Column]) -> Column:
    """SHA-256 (lowercase hex) of the columns in order: ``-`` for null, else byte count, ``:`` and the value as text."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _depth(n: Column) -> Column:
    """Levels above ``n`` leaves: how often ``n`` can be halved, upwards, until it is one."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def _number(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions of the leaves ``grp, id, leaf, ...`` within their group, and the groups ``g, n, depth`` in order.

    The rows are sorted by ranges of (group, id, leaf); a position is the row's place in its range plus the rows of its group
    in earlier ranges, of which there is one number per (range, group).
    """
    spark = leaves.sparkSession
    by = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("rid")]
    ranged = stored(leaves.repartitionByRange(max(2, width(spark)), *by).sortWithinPartitions(*by).withColumns(
        {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranged")
    parts = stored(ranged.groupBy("grp", "part").agg(F.count("*").alias("rows"), F.min("at").alias("low")), "parts")
    groups = parts.groupBy("grp").agg(F.sum("rows").alias("n"))
    # one row a group: its rank is a position among positions, so groups are ranked by the same ranges
    order = groups.repartitionByRange(max(2, width(spark)), F.col("grp").asc_nulls_first()).sortWithinPartitions(
        F.col("grp").asc_nulls_first()).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    order = stored(order, "groups")
    heads = order.groupBy("part").agg(F.count("*").alias("rows"), F.min("at").alias("low"))  # one row a range
    before = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("part", "low", before.alias("before"))
    ranks = stored(order.join(heads, "part").select(
        "grp", "n", _depth(F.col("n")).alias("depth"), (F.col("at") - F.col("low") + F.col("before")).alias("g")), "ranks")
    w = W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # at most one row a range
    offsets = parts.select("grp", "part", "low", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("before"))
    offsets = stored(offsets.join(ranks, offsets.grp.eqNullSafe(ranks.grp)).select(
        "part", offsets.grp, "low", "before", "g", "depth"), "offsets")
    few = small_bytes(offsets, offsets.count(), 256)
    placed = ranged.join(few, (ranged.part == few.part) & ranged.grp.eqNullSafe(few.grp)).select(
        *[ranged[c] for c in leaves.columns if c not in ("grp", "rid")], "g", "depth", (F.col("at") - F.col("low") + F.col("before")).alias("pos"))
    placed = stored(placed, "leaves")
    dropped(ranged, parts, order, offsets)
    return placed, ranks


def _pair(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(a, F.coalesce(b, F.lit(""))), 256)


def tree(leaves: DataFrame) -> DataFrame:
    """Nodes ``g, level, pos, depth, hash, sibling`` of all trees over the leaves ``g, depth, pos, hash``, leaves included.

    ``sibling`` is the other node of the pair, null for a node alone and for a root. A block of leaves is one array of at
    most ``2 ** BLOCK_LEVELS`` digests; its levels are computed inside one expression, and the blocks' tops are the leaves of
    the next table.
    """
    base, now, made = 0, leaves.select("g", "depth", "pos", "hash"), []
    while True:
        block = now.groupBy("g", "depth", F.shiftright("pos", BLOCK_LEVELS).alias("block")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("low"))
        steps = F.least(F.lit(BLOCK_LEVELS), F.col("depth") - base)

        def above(rows: Column, _: Column) -> Column:
            last = F.element_at(rows, -1)
            up = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(last) - 1, 1)),
                             lambda i: _pair(F.get(last, 2 * i), F.get(last, 2 * i + 1)))
            return F.concat(rows, F.array(up))

        levels = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), F.array("low"), above)).otherwise(F.array("low"))
        level = block.select("g", "depth", "block", F.posexplode(levels).alias("step", "row"))
        node = level.select("g", "depth", "block", "step", "row", F.posexplode("row").alias("i", "hash"))
        pos = F.col("block") * F.expr(f"shiftleft(1L, {BLOCK_LEVELS} - step)") + F.col("i")
        root = F.col("step") + base == F.col("depth")
        node = node.select("g", "depth", (F.col("step") + base).alias("level"), pos.alias("pos"), "hash", F.when(
            ~root, F.get("row", F.when(F.col("i") % 2 == 0, F.col("i") + 1).otherwise(F.col("i") - 1))).alias("sibling"))
        top = base + BLOCK_LEVELS
        nodes = stored(node, "nodes")
        # a block's top belongs to the next table, where its sibling is known
        made.append(nodes.where((F.col("level") < top) | (F.col("depth") <= top)))
        now = nodes.where((F.col("level") == top) & (F.col("depth") > top)).select("g", "depth", "pos", "hash")
        if not now.limit(1).count():
            break
        base = top
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def _step(sibling: Column, pos: Column) -> Column:
    """One step of a segment in binary: the side and the digest, which is all zero where there is no sibling."""
    side = F.when(sibling.isNull(), ALONE).when(pos % 2 == 1, LEFT).otherwise(RIGHT)
    return F.concat(side.cast("binary"), F.unhex(F.coalesce(sibling, F.lit("0" * 64))))


def _pointers(nodes: DataFrame, top: DataFrame) -> DataFrame:
    """``g, level, pos`` with the parent ``pg, plevel, ppos`` (null at the root) and the segment on the way to it.

    A group's root is a leaf of the upper tree, whose pointer it takes.
    """
    def parent(df):
        up = F.col("level") < F.col("depth")
        return df.select("g", "level", "pos", F.when(up, F.col("g")).alias("pg"), F.when(up, F.col("level") + 1).alias("plevel"),
                         F.when(up, F.shiftright("pos", 1)).alias("ppos"), F.when(up, _step(F.col("sibling"), F.col("pos"))).otherwise(
                             F.lit(b"")).alias("seg"))

    inner = parent(nodes.where("level < depth"))
    upper = parent(top.where("level > 0"))
    roots = nodes.where("level = depth").select("g", "level", "pos")
    tops = parent(top.where("level = 0")).select(F.col("pos").alias("g"), "pg", "plevel", "ppos", "seg")
    return inner.unionByName(upper).unionByName(roots.join(tops, "g").select(*inner.columns))


def _jump(left: DataFrame, nodes: DataFrame, keep: Sequence[str], hint: bool) -> DataFrame:
    """``left`` moved on by the pointers of the nodes that it points to."""
    right = nodes.select(F.col("g").alias("pg"), F.col("level").alias("plevel"), F.col("pos").alias("ppos"),
                         F.col("pg").alias("ng"), F.col("plevel").alias("nlevel"), F.col("ppos").alias("npos"), F.col("seg").alias("more"))
    right = F.broadcast(right) if hint else right
    return left.join(right, ["pg", "plevel", "ppos"]).select(
        *keep, F.col("ng").alias("pg"), F.col("nlevel").alias("plevel"), F.col("npos").alias("ppos"), F.concat("seg", "more").alias("seg"))


def proofs(nodes: DataFrame, top: DataFrame) -> DataFrame:
    """``g, pos, seg`` of every leaf: the siblings from the leaf to the root in steps of ``STEP`` bytes.

    Round r joins leaves with nodes at distance 2^r. There are at most leaves / 2^(2^r - 1) of these in the groups' trees: from
    round 4 on they are either few enough in bytes to be broadcast, or a key has no more than 2^16 leaves.
    """
    table = stored(_pointers(nodes, top), "pointers")
    leaves = table.where(f"level = 0 AND g <> {_TOP}").select("g", "pos", "pg", "plevel", "ppos", "seg")
    inner, done, distance = table.where(f"level > 0 OR g = {_TOP}"), [], 1
    while True:
        done.append(leaves.where("pg IS NULL").select("g", "pos", "seg"))
        going = leaves.where("pg IS NOT NULL")
        if not going.limit(1).count():
            break
        reached = inner.where(f"level >= {distance} OR g = {_TOP}")
        hint = reached.count() * (STEP * distance + 64) <= 16 << 20
        leaves = stored(_jump(going, reached, ["g", "pos"], hint), "paths")
        ahead = inner.where(f"level >= {2 * distance} OR g = {_TOP}")
        moved = _jump(ahead.where("pg IS NOT NULL"), reached, ["g", "level", "pos"], hint)
        inner = stored(moved.unionByName(ahead.where("pg IS NULL").select(*moved.columns)), "pointers")
        distance *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def steps(seg: Column) -> Column:
    """A segment as ``array<struct<side, digest>>`` from the leaf upwards."""
    at = F.sequence(F.lit(0), (F.length(seg) / STEP).cast("int") - 1)
    one = F.transform(at, lambda i: F.struct(
        F.decode(F.substring(seg, STEP * i + 1, F.lit(1)), "UTF-8").alias("side"),
        F.lower(F.hex(F.substring(seg, STEP * i + 2, F.lit(STEP - 1)))).alias("digest")))
    return F.when(F.length(seg) >= STEP, one).otherwise(F.array().cast("array<struct<side:string,digest:string>>"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give; null for a null leaf."""
    return F.aggregate(path, leaf.cast("string"), lambda h, s: F.when(h.isNull(), h).when(s["side"] == ALONE, _pair(h, F.lit(None))).when(
        s["side"] == LEFT, _pair(s["digest"], h)).otherwise(_pair(h, s["digest"])))


def manifest(docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "lang",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """``id, leaf, subroot, root, path`` and the ``carry`` columns (expressions over ``docs``) of every row.

    A leaf hashes ``columns``. Within a group leaves ascend by id (null first); rows that share an id stand in the order of
    their leaves, so rows that repeat are leaves next to each other and the result does not depend on the order read. A null
    group comes first and is a group like others; groups ascend by their UTF-8 bytes. ``path`` is
    ``array<struct<side, digest>>`` from the leaf to the root: the sibling comes first (``L``), second (``R``), or there is
    none (``-``). One row in all is a leaf, subroot and root with an empty path; an empty table gives no rows. Texts are hashed
    where they are read, however long, and never shuffled. Other columns of ``docs`` may have any names.
    """
    carry = carry or {}
    extra = [f"carry_{k}" for k in carry]
    hashed = stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf_hash(columns).alias("leaf"), *[c.alias(f"carry_{k}") for k, c in carry.items()]), "hashed")
    leaves, ranks = _number(hashed)
    nodes = tree(leaves.withColumnRenamed("leaf", "hash"))
    roots = stored(nodes.where("level = depth").select("g", F.col("hash").alias("subroot")), "subroots")
    groups = roots.count()
    over = _depth(F.lit(groups))
    top = tree(roots.select(F.lit(_TOP).cast("long").alias("g"), over.alias("depth"), F.col("g").alias("pos"),
                            F.col("subroot").alias("hash")))
    last = top.where("level = depth").select("hash").first()
    found = proofs(nodes, top)
    out = leaves.join(found, ["g", "pos"]).join(small_bytes(roots, groups, 128), "g").select(
        "id", "leaf", "subroot", F.lit(last["hash"] if last else None).cast("string").alias("root"), steps(F.col("seg")).alias("path"),
        *[F.col(c).alias(k) for c, k in zip(extra, carry)])
    dropped(hashed)
    return out
