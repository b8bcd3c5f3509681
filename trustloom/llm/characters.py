"""Interpolated modified Kneser-Ney model over whole characters, in Spark tables; documents are scored by joins with them.

An n-gram is ``ORDER`` characters, 21 bits each, in two numbers: ``lo`` the last three, ``hi`` those before. Nothing limits the
alphabet, and the tables grow with the different n-grams of the corpus.

How the data moves. Tasks cut their documents into blocks of about ``BLOCK`` characters and write each block's texts, packed, and
its different n-grams with their counts in both halves of the trusted texts. Beside its input a task holds a few steps of ``STEP``
characters, its different n-grams and, while it scores, about two bytes a character. Counts are added by n-gram, those of the lower orders
by suffix; windows over each context give totals and discounts, joins by suffix give the lower order's probabilities. Blocks ask
for their n-grams by a join with the highest order and meet the answers by block number. A context has at most one row per
character that follows it, an n-gram one per block, so no key is hot. Neither driver nor tasks hold the model.

Three models are built at once, as columns: of either half of the trusted texts, and of both.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from trustloom.llm.common import dropped, stored
from trustloom.llm.pitman_yor import pack, unpack

ORDER, EDGE, BITS = 5, 0, 21
BLOCK, STEP = 1 << 25, 1 << 20  # characters of a block, and those looked at together
MERGED = 8  # steps whose n-grams are put together at once
ASKED = 1 << 20  # answers packed together
MODELS = (0, 1, 2)  # first half, second half, both
LOW = 3 * BITS


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3+ from the numbers of n-grams seen once to four times.

    One that can't be estimated or isn't positive, which would leave nothing for unseen n-grams, is 0.5.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    ratios = (1, n2, n1), (2, n3, n2), (3, n4, n3)
    found = (k - (k + 1) * y * b / a if a else 0.0 for k, b, a in ratios)
    return tuple(min(x, float(k)) if x > 0 else 0.5 for k, x in enumerate(found, 1))


def grams(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``hi, lo, owner`` of all n-grams, about ``STEP`` at a time: one per character and one for the end of each text.

    ``owner`` is the number of the text. Before a text stand ``ORDER - 1`` edges, behind it one.
    """

    def made(parts, owners, first, last):
        length = np.array([len(p) for p in parts])
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        end = np.cumsum(length)
        points[(end - length)[np.array(first)][:, None] + np.arange(ORDER - 1)] = EDGE
        points[end[np.array(last)] - 1] = EDGE
        cross = np.zeros(len(points), bool)  # n-grams that begin here reach into the next part
        cross[end[:, None] - np.arange(1, ORDER)] = True
        at = np.flatnonzero(~cross)
        hi, lo = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(ORDER - 3):
            hi = hi << BITS | points[at + k]
        for k in range(ORDER - 3, ORDER):
            lo = lo << BITS | points[at + k]
        return hi, lo, np.repeat(np.array(owners), length - ORDER + 1)

    parts, owners, first, last, n = [], [], [], [], 0
    for k, text in enumerate(texts):
        for s in range(0, max(1, len(text)), STEP):
            stop = s + STEP
            parts.append((text[s - ORDER + 1:stop] if s else "\0" * (ORDER - 1) + text[:stop]) + "\0" * (stop >= len(text)))
            owners.append(k)
            first.append(s == 0)
            last.append(stop >= len(text))
            n += len(parts[-1])
            if n >= STEP:
                yield made(parts, owners, first, last)
                parts, owners, first, last, n = [], [], [], [], 0
    if parts:
        yield made(parts, owners, first, last)


def _numbered(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams in no fixed order, and the number of each one given among them."""
    a, b = (pa.array(x).dictionary_encode() for x in (hi, lo))
    n = len(b.dictionary)
    both = pa.array(a.indices.to_numpy().astype(np.int64) * n + b.indices.to_numpy()).dictionary_encode()
    seen = both.dictionary.to_numpy()
    return a.dictionary.to_numpy()[seen // n], b.dictionary.to_numpy()[seen % n], both.indices.to_numpy()


def _union(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Different n-grams of several lists by ``hi, lo``, and per list the place of each of its n-grams."""
    hi, lo, at = _numbered(*(np.concatenate(x) for x in zip(*found)))
    order = np.lexsort((lo, hi))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return hi[order], lo[order], np.split(place[at], np.cumsum([len(x) for x, _ in found])[:-1])


NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _counted(texts: Iterable[str], half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hi, lo`` of the different n-grams in order, and their counts in texts whose ``half`` is 0, 1 and 2."""
    found, counts = [NONE], [np.zeros((3, 0), np.int64)]

    def merge():
        hi, lo, places = _union(found)
        total = np.zeros((3, len(hi)), np.int64)
        for place, some in zip(places, counts):
            total[:, place] += some  # a list holds an n-gram once
        found[:], counts[:] = [(hi, lo)], [total]

    for hi, lo, owner in grams(texts):
        hi, lo, at = _numbered(hi, lo)
        found.append((hi, lo))
        counts.append(np.stack([np.bincount(at[half[owner] == k], minlength=len(hi)) for k in (0, 1, 2)]))
        if len(found) > MERGED:
            merge()
    merge()
    return *found[0], counts[0]


def _unpacked(body: bytes, sizes: list[int]) -> Iterator[str]:
    """Texts of a block one after another, decompressed about ``STEP`` bytes at a time; ``sizes`` are their bytes."""
    stream, held, at = bz2.BZ2Decompressor(), b"", 0
    for n in sizes:
        while len(held) - at < n:
            held, at, body = held[at:] + stream.decompress(body, max(STEP, n - len(held) + at)), 0, b""
        yield held[at:at + n].decode("utf-8", "surrogatepass")
        at += n


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of blocks of ``docs`` (``id, lang, body, half``; half 0 or 1 of the trusted ones, null for others).

    ``part`` 0: the block's documents; 1: one of its n-grams, numbered in order, with its counts in both halves and in other texts.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def flush(block, slices):
        ids, langs = (pa.concat_arrays([s.column(k) for s in slices]) for k in (0, 1))
        half = np.concatenate([s.column(3).fill_null(2).to_numpy(zero_copy_only=False) for s in slices]).astype(np.uint8)
        squeeze, body, sizes = bz2.BZ2Compressor(), [], []

        def texts():
            for t in (t for s in slices for t in s.column(2)):
                text = t.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                body.append(squeeze.compress(data))
                yield text

        hi, lo, total = _counted(texts(), half)
        body = pack(b"".join([*body, squeeze.flush()]), np.array(sizes, np.uint32), half)
        one = pa.array([0, len(ids)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), *[pa.nulls(1, t) for t in (pa.int32(), *[pa.int64()] * 5)],
             pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, langs), pa.array([body], pa.binary()),
             pa.array([0], pa.int32())], NAMES)
        for s in range(0, len(hi), 100_000):
            part = slice(s, min(s + 100_000, len(hi)))
            m = part.stop - s
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, block)), pa.array(np.arange(s, part.stop, dtype=np.int32)),
                 *[pa.array(x[part]) for x in (hi, lo, *total)], pa.nulls(m, pa.list_(ids.type)),
                 pa.nulls(m, pa.list_(langs.type)), pa.nulls(m, pa.binary()), pa.array(np.ones(m, np.int32))], NAMES)

    def run(batches):
        block, slices, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            start = 0
            for k, t in enumerate(batch.column(2)):
                n += len(t.as_py() or "") + 1
                if n >= BLOCK:
                    yield from flush(block, [*slices, batch.slice(start, k + 1 - start)])
                    block, slices, n, start = block + 1, [], 0, k + 1
            if start < len(batch):
                slices.append(batch.slice(start))
        if slices:
            yield from flush(block, slices)

    return docs.select("id", "lang", "body", "half").mapInArrow(
        run, f"block long, at int, hi long, lo long, n0 long, n1 long, others long, ids array<{kind}>, langs array<string>, "
        "body binary, part int")


NAMES = ["block", "at", "hi", "lo", "n0", "n1", "others", "ids", "langs", "body", "part"]


def _suffix(order: int) -> tuple[Column, Column]:
    """The last ``order`` characters of longer n-grams."""
    hi, lo = F.col("hi"), F.col("lo")
    if order > 3:
        return hi.bitwiseAND(F.lit((1 << BITS * (order - 3)) - 1)), lo
    return F.lit(0).cast("long"), lo.bitwiseAND(F.lit((1 << BITS * order) - 1))


def probabilities(counts: DataFrame) -> DataFrame:
    """``hi, lo, p0, p1, p2``: per row of ``counts`` (``hi, lo, n0, n1``: different n-grams of the highest order, counted in both
    halves, 0 where only asked for) the probability of the last character after those before, in the models of ``MODELS``.

    Highest order: plain counts; below: in how many contexts an n-gram occurs. Below the single characters all characters of the
    trusted texts and one for all unknown ones are equally probable.
    """
    tables = {ORDER: stored(counts.withColumn("n2", F.col("n0") + F.col("n1")), "grams")}
    for order in range(ORDER - 1, 0, -1):
        hi, lo = _suffix(order)
        tables[order] = stored(tables[order + 1].groupBy(hi.alias("hi"), lo.alias("lo")).agg(
            *[F.count_if(F.col(f"n{j}") > 0).alias(f"n{j}") for j in MODELS]), "grams")
    lower = None
    for order in range(1, ORDER + 1):
        table = tables[order]
        often = {(j, k): (F.col(f"n{j}") == k) if k < 3 else (F.col(f"n{j}") >= 3) for j in MODELS for k in (1, 2, 3)}
        stats = table.agg(*[F.count_if(F.col(f"n{j}") == k).alias(f"{j}_{k}") for j in MODELS for k in (1, 2, 3, 4)],
                          *[F.sum(f"n{j}").alias(f"total{j}") for j in MODELS],
                          *[F.count_if(often[j, k]).alias(f"seen{j}_{k}") for j, k in often]).first()
        d = {j: discounts(*[stats[f"{j}_{k}"] for k in (1, 2, 3, 4)]) for j in MODELS}
        if order == 1:
            known = sum(stats[f"seen2_{k}"] for k in (1, 2, 3))
            rows = table.withColumns({f"p{j}": F.lit(1.0 / (known + 1)) for j in MODELS} | {
                x: F.lit(stats[x]) for x in [*[f"total{j}" for j in MODELS], *[f"seen{j}_{k}" for j, k in often]]})
        else:
            whole = Window.partitionBy("hi", F.shiftright("lo", BITS))  # a context; its rows are different characters
            rows = table.withColumns({f"total{j}": F.sum(f"n{j}").over(whole) for j in MODELS} | {
                f"seen{j}_{k}": F.count_if(x).over(whole) for (j, k), x in often.items()})
            low_hi, low_lo = _suffix(order - 1)
            rows = rows.withColumns({"low_hi": low_hi, "low_lo": low_lo}).join(
                lower.withColumnsRenamed({"hi": "low_hi", "lo": "low_lo"}), ["low_hi", "low_lo"])
        out = []
        for j in MODELS:
            n, total = F.col(f"n{j}"), F.col(f"total{j}")
            own = F.when(n == 0, 0.0).when(n == 1, 1 - d[j][0]).when(n == 2, 2 - d[j][1]).otherwise(n - F.lit(d[j][2]))
            taken = sum((F.col(f"seen{j}_{k}") * F.lit(d[j][k - 1]) for k in (1, 2, 3)), F.lit(0.0))
            out.append(F.when(total > 0, (own + taken * F.col(f"p{j}")) / total).otherwise(F.col(f"p{j}")).alias(f"p{j}"))
        if order > 1:
            done = lower
        lower = stored(rows.select("hi", "lo", *out), "probabilities")
        dropped(table, *([done] if order > 1 else []))
    return lower


def packed(found: DataFrame) -> DataFrame:
    """``block, answers``: rows ``block, at, b0, b1, b2`` of a task put together by block, ``ASKED`` at a time."""

    def flush(rows):
        block, at, *b = (c.to_numpy() for c in pa.Table.from_batches(rows).columns)
        order = np.lexsort((at, block))
        block = block[order]
        first = np.flatnonzero(np.diff(block, prepend=-1))
        parts = [pack(np.diff(at[mine], prepend=0).astype(np.uint32), *[x[mine] for x in b]) for mine in np.split(order, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(parts, pa.binary())], ["block", "answers"])

    def run(batches):
        rows, n = [], 0
        for batch in batches:
            if len(batch):
                rows.append(batch)
                n += len(batch)
            if n >= ASKED:
                yield flush(rows)
                rows, n = [], 0
        if rows:
            yield flush(rows)

    return found.mapInArrow(run, "block long, answers binary")


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed with bytes of equal weight together."""
    return pa.Codec("lz4").compress(np.concatenate([(x >> 8 * k).astype(np.uint8) for k in range(4)]), asbytes=True)


def _restored(data: bytes, n: int) -> np.ndarray:
    first, *rest = np.frombuffer(pa.Codec("lz4").decompress(data, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    out = first.astype(np.uint32)
    for k, x in enumerate(rest, 1):
        out |= x.astype(np.uint32) << 8 * k
    return out


def _scored(block: pa.Table, values: pa.Table) -> pa.Table:
    """Scores of a block's documents, from its row and the answers to its n-grams.

    The place of an n-gram is known when all have been read; until then each character has its number within its step, packed.
    """
    body, sizes, half = unpack(block.column("body")[0].as_py(), "b u4 u1")
    model, length = np.array([1, 0, 2])[half], []
    found, places, chunks = [NONE], [], []

    def merge():
        hi, lo, (known, *new) = _union(found)
        places[:] = [x.astype(np.uint32) for x in (*[known[p] for p in places], *new)]
        found[:] = [(hi, lo)]

    def texts():
        for text in _unpacked(body, sizes.tolist()):
            length.append(len(text))
            yield text

    for hi, lo, owner in grams(texts()):
        hi, lo, index = _numbered(hi, lo)
        found.append((hi, lo))
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        chunks.append((_squeezed(index), owner[first], first, len(index)))
        if len(found) > MERGED:
            merge()
    merge()
    table, known = np.zeros((3, len(found[0][0])), np.float32), 0
    for answer in values.column("answers"):
        place, *got = unpack(answer.as_py(), "u4 f4 f4 f4")
        table[:, np.cumsum(place, dtype=np.int64)] = got
        known += len(place)
    if known != table.shape[1]:
        raise ValueError(f"{known} answers to {table.shape[1]} n-grams of a block")
    total, n = np.zeros(len(length)), np.array(length, np.int64) + 1
    for (index, owner, first, m), place in zip(chunks, places):
        events = np.repeat(model[owner], np.diff(first, append=m))
        total[owner] += np.add.reduceat(table[events, place[_restored(index, m)]].astype(np.float64), first)
    ids, langs = (block.column(c).combine_chunks().flatten() for c in ("ids", "langs"))
    return pa.Table.from_arrays([ids, langs, pa.array(n), pa.array(np.round(total / n, 3)), pa.array(half < 2)],
                                ["id", "lang", "n_events", "bits", "good"])


def scores(docs: DataFrame) -> DataFrame:
    """``id, lang, n_events, bits, good`` of every row of ``docs`` (``id, lang, body, half``), as a stored table.

    ``bits`` are per character (base-2 logarithm of the perplexity), on a grid of 1/1000. Every text also has the event of its end,
    so an empty or null text has a score too. Trusted documents (``good``) are scored by the model of the other half, others by
    that of both.
    """
    kind = docs.schema["id"].dataType
    table = stored(blocks(docs), "blocks", "part")
    asked = table.where("part = 1")
    p = probabilities(asked.groupBy("hi", "lo").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    bits = [(-F.log2(F.col(f"p{j}"))).cast("float").alias(f"b{j}") for j in MODELS]
    need = zip(MODELS, ("n1", "n0", "others"))  # a block gets what its documents are scored by
    found = asked.select("block", "at", "hi", "lo", *[(F.col(n) > 0).alias(f"need{j}") for j, n in need]).join(
        p.select("hi", "lo", *bits), ["hi", "lo"])
    answers = stored(packed(found.select("block", "at", *[F.when(F.col(f"need{j}"), F.col(f"b{j}")).otherwise(
        F.lit(0.0).cast("float")).alias(f"b{j}") for j in MODELS])), "answers")
    asked.scratch = f"{table.scratch}/part=1"
    dropped(asked, p)

    rows = table.where("part = 0").select("block", "ids", "langs", "body").groupBy("block").cogroup(
        answers.groupBy("block")).applyInArrow(
        _scored, f"id {kind.simpleString()}, lang string, n_events long, bits double, good boolean")
    out = stored(rows, "scores")
    dropped(table, answers)
    return out
