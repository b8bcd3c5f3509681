"""How far the sources of a language differ in their use of words: exact sums over all terms, by a frequent-pattern tree.

Every (language, source) group gives each kept term a share in parts of ``SCALE`` (add-two smoothing, whole numbers). Two
groups differ by the sum over the terms of ``floor((p - q)^2 / (p + q))``. A term that neither group has adds the same number
for every such term, so sums start from "no term occurs" and are corrected:

* each source's histogram of shares corrects the pairs in which the other source lacks the term;
* where both have it, the correction depends on the two shares only. Term rows, the nonzero shares in the order of the
  sources, go into a frequent-pattern tree: rows with a common beginning share its nodes and add up their number there. Every
  (node, ancestor) combination then gives its correction once, times the node's number, however many terms pass through.

Rows are sorted by their path over all tasks, so a task builds its part of the tree from consecutive rows, level by level; a
node that spans two parts is met in both with a part of its number, which adds up to the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trustloom.llm.common import dropped, small_bytes, stored, width

SCALE, MIN_DOCS, TOP = 1_000_000_000, 10, 10
BLOCK = 4 << 20  # bytes of text whose tokens are numbered at once
CELLS = 1 << 18  # entries of the paths that a task puts into one part of the tree
# Bytes of a term: A-Z (lower-cased), a-z and everything outside ASCII; the rest separates.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _blocks(texts: list[bytes], size: int) -> Iterator[list[tuple[int, bytes]]]:
    """Whole texts in blocks of about ``size`` bytes; a longer text is a block of its own."""
    block, held = [], 0
    for i, t in enumerate(texts):
        if block and held + len(t) > size:
            yield block
            block, held = [], 0
        block.append((i, t))
        held += len(t)
    if block:
        yield block


def _long(text: bytes, size: int) -> dict[bytes, int]:
    """Term counts of one long text, read in pieces that end at separators."""
    counts, start = {}, 0
    while start < len(text):
        end = min(len(text), start + size)
        while end < len(text) and text[end] != 32:
            end += 1
        for w in text[start:end].split():
            counts[w] = counts.get(w, 0) + 1
        start = end
    return counts


def _counted(batches: Iterator[pa.RecordBatch], size: int = BLOCK):
    """Per block of texts: ``lang, source, term, n, docs`` with the occurrences and the texts of each term."""
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        lang, source = (batch.column(i).to_pylist() for i in (0, 1))
        keys = {}
        group = np.array([keys.setdefault(k, len(keys)) for k in zip(lang, source)], np.int64)
        which = list(keys)
        texts = [t.as_py().translate(_TO_TERMS) for t in batch.column(2).cast(pa.binary())]
        for block in _blocks(texts, size):
            if len(block) == 1 and len(block[0][1]) > size:
                counts = _long(block[0][1], size)
                words, n = pa.array(list(counts), pa.binary()), np.fromiter(counts.values(), np.int64, len(counts))
                g, docs = np.full(len(n), group[block[0][0]]), np.ones(len(n), np.int64)
                term = np.arange(len(n))
            else:
                split = [t.split() for _, t in block]
                lengths = np.array([len(s) for s in split])
                coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
                words = coded.dictionary
                if not len(words):
                    continue
                term = coded.indices.to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(block)), lengths)
                pair, times = np.unique(doc * len(words) + term, return_counts=True)
                of = group[[i for i, _ in block]][pair // len(words)]
                cell, at = np.unique(of * len(words) + pair % len(words), return_inverse=True)
                n = np.bincount(at, times, len(cell)).astype(np.int64)
                docs = np.bincount(at, minlength=len(cell)).astype(np.int64)
                g, term = cell // len(words), cell % len(words)
            yield pa.RecordBatch.from_arrays([
                pa.array([which[k][0] for k in g], pa.string()), pa.array([which[k][1] for k in g], pa.string()),
                words.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs)], names)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term and documents with it, of ``lang, source, text``."""
    parts = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a count in parts of ``SCALE``, exact for any 64-bit count."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", (whole(n) + 2) * F.lit(SCALE).cast("decimal(10,0)"), whole(total) + 2 * whole(terms))


def apart(p: Column, q: Column) -> Column:
    """What one term adds to the difference of two groups; shares are at most ``SCALE + 1``, so all of it fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _padded(flat: np.ndarray, lengths: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(lengths), int(lengths.max(initial=0))), fill, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    names, first = np.unique(keys[order], return_index=True)
    return names, np.add.reduceat(values[order], first) if len(names) else values


def _nodes(at: np.ndarray, p: np.ndarray, p0: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair sums by ``a * 2^32 + b`` from sorted paths (padded with -1), level by level of their tree.

    A row opens a node at a level if its path up to there differs from that of the row before; the node's number is the sum over
    the rows until the next one opens. Each node then meets all its ancestors once.
    """
    lengths = (at >= 0).sum(1)
    same = (at[1:] == at[:-1]) & (p[1:] == p[:-1]) & (at[1:] >= 0)
    common = np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(1)]) if len(at) else np.zeros(0, np.int64)
    keys, values = [], []
    for d in range(1, at.shape[1]):
        rows = np.flatnonzero(lengths > d)
        opens = np.flatnonzero(common[rows] <= d)
        if not len(opens):
            continue
        number, node = np.add.reduceat(m[rows], opens), rows[opens]
        x, x0, y, y0 = p[node, d][:, None], p0[node, d][:, None], p[node, :d], p0[node, :d]
        got = number[:, None] * (_apart(x, y) - _apart(x, y0) - _apart(x0, y) + _apart(x0, y0))
        k, v = _summed(((at[node, d][:, None] << 32) + at[node, :d]).ravel(), got.ravel())
        keys.append(k)
        values.append(v)
    return _summed(np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0, np.int64)]))


def _tree(batches: Iterator[pa.RecordBatch]):
    """Corrections ``lang, a, b, v`` of pairs of sources (numbers, a after b) from sorted paths ``lang, at, p, p0, m``.

    ``at``: source numbers of the row in order; ``p``: their shares; ``p0``: the shares of an absent term; ``m``: terms with
    this row. A part of the tree is made of rows with at most ``CELLS`` entries, whatever the batch; a node that is in two
    parts has a part of its number in each.
    """
    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        lang = np.array(batch.column(0).to_pylist(), object)
        cuts = set((np.flatnonzero(lang[1:] != lang[:-1]) + 1).tolist())
        start = 0
        while start < len(lang):
            most, end = 0, start
            while end < len(lang) and (end == start or end not in cuts) and (end == start or (
                    end - start + 1) * max(most, lengths[end]) <= CELLS):
                most, end = max(most, int(lengths[end])), end + 1
            part = batch.slice(start, end - start)
            at, p, p0 = (_padded(part.column(c).flatten().to_numpy(zero_copy_only=False), lengths[start:end], -1) for c in (1, 2, 3))
            keys, values = _nodes(at, p, p0, part.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([
                pa.array([lang[start]] * len(keys), pa.string()), pa.array((keys >> 32).astype(np.int32)),
                pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(values)], ["lang", "a", "b", "v"])
            start = end


def _alone(batches: Iterator[pa.RecordBatch]):
    """Rows ``lang, at, p0, terms, hist, all``: the difference to every other source ``b`` of the language if no term occurred
    in either (``base``, over all terms), and the corrections of the source's own terms where b lacks them (``v``)."""
    for batch in batches:
        lang, at, p0, terms = (batch.column(i).to_pylist() for i in range(4))
        for i in range(len(lang)):
            b, q0 = (batch.column(5)[i].values.field(f).to_numpy() for f in (0, 1))
            none, total = _apart(np.int64(p0[i]), q0), np.zeros(len(b), np.int64)
            if batch.column(4)[i].is_valid:
                for p, m in zip(*(batch.column(4)[i].values.field(f).to_numpy() for f in (0, 1))):
                    total += m * (_apart(p, q0) - none)
            other = b != at[i]
            n = int(other.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array([lang[i]] * n, pa.string()), pa.array(np.full(n, at[i], np.int32)), pa.array(b[other]),
                pa.array((terms[i] * none)[other]), pa.array(total[other])], ["lang", "a", "b", "base", "v"])


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *,
               min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) group that occurs.

    Part ``pair``: ``item`` is each other source of the language, ``value`` their difference over all kept terms, all ranks.
    Part ``term``: ``item`` is a kept term that the group uses more than the language as a whole, ``value`` what the term adds
    to their difference, ranks up to ``top``. Kept terms are in at least ``min_docs`` of the language's documents. Ranks go by
    value, descending, then by the item's UTF-8 bytes.

    Null languages, sources and texts count as empty. A group without terms is a group like others; without kept terms all
    its differences are 0. A language with one source has no pairs. An empty table gives no rows. Repeated rows count as
    often as they occur; other columns of ``docs`` may have any names. A very long text is read in pieces; a task holds the
    counts of about ``BLOCK`` bytes of text. A row of the tree has at most one entry for each source of its language.
    """
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = stored(term_counts(rows), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = stored(kept.where(F.col("docs") >= min_docs).select("lang", "term", "total"), "kept")
    used = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "used")
    # one row a group, at most as many as (language, source) pairs
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "terms", "total")])
    order = F.row_number().over(W.partitionBy("lang").orderBy("source"))
    zero = F.lit(0).cast("long")
    groups = stored(groups.withColumn("at", order).withColumn("p0", F.when(F.col("terms") > 0, share(zero, F.col("size"), F.col(
        "terms"))).otherwise(F.lit(1).cast("long"))), "groups")
    n_groups = groups.count()
    sizes = groups.agg(F.coalesce(F.max(F.octet_length("lang") + F.octet_length("source")), F.lit(0))).first()[0]
    few = lambda *cols: small_bytes(groups.select("lang", "source", *cols), n_groups, 2 * sizes + 96)
    shares = stored(used.join(few("at", "size", "terms", "p0", F.col("total").alias("all")), ["lang", "source"]).select(
        "lang", "source", "term", "at", "p0", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"),
        share(F.col("total"), F.col("all"), F.col("terms")).alias("q")), "shares")

    dropped(counts, kept, used)

    # terms a group uses more than its language
    over = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = over.withColumn("rank", rank).where(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # the tree: equal rows become one, rows sorted by path
    path = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("at", "p", "p0"))).alias("path"))
    path = stored(path.groupBy("lang", "path").agg(F.count("*").alias("m")), "paths")
    parts = max(2, width(docs.sparkSession))
    ranged = path.repartitionByRange(parts, "lang", "path").sortWithinPartitions("lang", "path")
    each = lambda name: F.transform("path", lambda x: x[name]).alias(name)
    both = ranged.select("lang", each("at"), each("p"), each("p0"), "m").mapInArrow(_tree, "lang string, a int, b int, v long")

    # pairs in which one source lacks the term
    hist = shares.groupBy("lang", "at", "p").agg(F.count("*").alias("m")).groupBy("lang", "at").agg(
        F.collect_list(F.struct("p", "m")).alias("hist"))
    everyone = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "p0"))).alias("all"))
    alone = groups.select("lang", "at", "p0", "terms").join(hist, ["lang", "at"], "left").join(everyone, "lang").select(
        "lang", "at", "p0", "terms", "hist", "all")
    alone = alone.mapInArrow(_alone, "lang string, a int, b int, base long, v long")
    one = stored(alone, "alone")
    swap = lambda df: df.unionByName(df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    sums = one.select("lang", "a", "b", F.col("base").alias("v")).unionByName(swap(one.select("lang", "a", "b", "v"))).unionByName(
        swap(both)).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    named = lambda name, at: few(F.col("at").alias(at)).select("lang", F.col("source").alias(name), at)
    pairs = sums.join(named("source", "a"), ["lang", "a"]).join(named("item", "b"), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return pairs.unionByName(terms)
