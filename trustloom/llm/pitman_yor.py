"""Language model: a hierarchical Pitman-Yor process, its seating sampled by Gibbs sweeps, run as Spark jobs.

Restaurants: one per context, all with the same parent, the restaurant without a context, whose base is uniform over the
training words and one unknown word. The context of a token is the whole word before it (``context_class``), so both the
restaurants and the vocabulary grow with the corpus.

How the data moves. Tasks number the words of a block of documents (at most ``BLOCK`` tokens, or one document) and write the
documents as word numbers, and the block's words with their counts, cut into buckets by a hash of the word. Buckets rank
their words by count and tell each block the ranks of its words; blocks then send their different (word, context) pairs to
the word's bucket. A bucket's state is one row. Before every sweep buckets send the tables of their contexts to the shard
of the context (``_shards`` of them, so that messages are far fewer than pairs of buckets) and get back the totals of these
restaurants, so no task and no driver holds all of them.
For scoring, buckets answer each block in the order of its pairs, and blocks meet their answers by block number. No text is
shuffled, no vocabulary is broadcast.

Sweep: for each word in each context all its customers stand up and sit down again one after another, given the other
words' tables, the parent's tables for the word, and the totals of the last sweep. Then the parent seats the tables it got.
Late customers of frequent words sit down in growing groups whose number of new tables is drawn at once.
"""

from __future__ import annotations

import math
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from trustloom.llm.common import dropped, stored, width, word_blocks

CONTEXTS = 1021  # restaurants that a state put together by hand may number; those of a corpus have no bound
BLOCK = 1_250_000
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0  # of both levels; the discounts are estimated
SEED = 20_240_601
ROWS = "kind int, bucket int, block long, held boolean, payload binary"


def context_class(word: bytes) -> bytes | int:
    """What a word is as the context of the next token: the word itself; 0 stands for the start of a text."""
    return word or 0


@cache
def _zstd():
    """One compressor and one decompressor per worker process."""
    import zstandard

    return zstandard.ZstdCompressor(level=5), zstandard.ZstdDecompressor()


def pack(*parts) -> bytes:
    """Bytes and arrays in one compressed value: unsigned numbers as wide as the largest needs, bytes of equal weight together."""
    sizes, raw = [], []
    for p in parts:
        wide = 1
        if not isinstance(p, bytes):
            if p.dtype.kind == "u":
                top = int(p.max()) if len(p) else 0
                p = p.astype(f"<u{1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8}")
            wide = p.itemsize
            p = np.ascontiguousarray(p).view(np.uint8).reshape(-1, wide).T.tobytes()
        sizes += [wide, len(p)]
        raw.append(p)
    return _zstd()[0].compress(b"".join([struct.pack(f"<{len(sizes) + 1}I", len(raw), *sizes), *raw]))


def unpack(data: bytes, kinds: str) -> list:
    """Parts of a packed value: "b" for bytes, else the numpy type code of the array."""
    raw = _zstd()[1].decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    sizes, at, out = struct.unpack_from(f"<{2 * n}I", raw, 4), 8 * n + 4, []
    for kind, wide, size in zip(kinds.split(), sizes[::2], sizes[1::2]):
        part = raw[at:at + size]
        if kind != "b":
            planes = np.frombuffer(part, np.uint8).reshape(wide, -1).T
            part = np.ascontiguousarray(planes).view(f"<{kind[0]}{wide}").ravel().astype(kind, copy=False)
        out.append(part)
        at += size
    return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _rows(kinds, buckets, blocks, ids, held, payloads, id_type):
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(blocks, pa.int64()), pa.array(held, pa.bool_()),
         pa.array(payloads, pa.binary()), pa.array(ids, id_type)], ["kind", "bucket", "block", "held", "payload", "id"])


def encode(docs: DataFrame, id_col: str, text_col: str, buckets: int, fold: int, of: int) -> DataFrame:
    """Rows of kind 0 (documents as word numbers) and 1 (a block's words of one bucket with their counts in training texts)."""

    def flush(numbers, ids, held, texts, block, id_type):
        words = list(numbers)
        train = np.repeat(~np.array(held, bool), [len(t) for t in texts])
        n = np.bincount(np.concatenate(texts)[train], minlength=len(words)).astype(np.uint64)
        for s in range(0, len(ids), 1000):
            part = slice(s, s + 1000)
            yield _rows([0] * len(ids[part]), [None] * len(ids[part]), [block] * len(ids[part]), ids[part], held[part],
                        [pack(t) for t in texts[part]], id_type)
        bucket = np.array([zlib.crc32(w) % buckets for w in words])
        order = np.argsort(bucket, kind="stable")
        parts = []
        for b, mine in zip(range(buckets), np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets)))):
            if len(mine):
                parts.append((b, pack(b" ".join([words[i] for i in mine.tolist()]), np.diff(mine, prepend=0).astype(np.uint32), n[mine])))
        yield _rows([1] * len(parts), [b for b, _ in parts], [block] * len(parts), [None] * len(parts), [None] * len(parts),
                    [p for _, p in parts], id_type)

    def run(batches):
        task, block = TaskContext.get().partitionId(), 0
        numbers, ids, held, texts, n, id_type = _Numbers({b"": 0}), [], [], [], 0, pa.null()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                parts = [np.fromiter(map(numbers.__getitem__, w), np.uint32, len(w)) for w in word_blocks((t.as_py() or b"").lower())]
                ids.append(i)
                held.append(h)
                texts.append(np.concatenate([*parts, np.zeros(1, np.uint32)]))
                n += len(texts[-1])
                if n >= BLOCK:
                    yield from flush(numbers, ids, held, texts, (task << 24) + block, id_type)
                    block, numbers, ids, held, texts, n = block + 1, _Numbers({b"": 0}), [], [], [], 0
        if ids:
            yield from flush(numbers, ids, held, texts, (task << 24) + block, id_type)

    kind = docs.schema[id_col].dataType.simpleString()
    away = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(of)) == fold
    return docs.select(F.col(id_col).alias("id"), away.alias("held"), F.col(text_col).alias("body")).mapInArrow(
        run, f"{ROWS}, id {kind}")


VOCABULARY = "u4 u4 u8"  # of a block's words in a bucket: numbers in the block as gaps, ranks in the bucket, counts
PAIRS = "u4 u4 u8 u4"  # of a block's pairs in a bucket: ranks of words as gaps, contexts per word, context numbers as gaps, counts
TOTALS = "u4 u8"  # of contexts: places in a shard, or ranks in the bucket of their word, as gaps; tables
# A bucket's state: ranks of its words, contexts per word, then per context its number in this state, customers, tables and
# summed own share of the prediction (in jobs left empty: the summed tables beside it say the same in less space), and per
# word tables of the parent and summed parent's prediction. Beside it: number of contexts per shard and their places there;
# summed tables per context of a word; and, for its words as contexts, ranks as gaps and summed tables.
STATE = "b u4 u4 u4 u4 f8 u4 f8"
STATE_ROW = "bucket int, payload binary, contexts binary, tables binary, back binary"
EMPTY = np.zeros(0, np.uint64)


def _shards(buckets: int) -> tuple[int, int]:
    """Number of shards of the contexts, and of buckets in each: bucket b is number b // shards of shard b % shards, and a
    context's place there is its rank times the shard's buckets, plus that number."""
    shards = 2 * math.isqrt(buckets)
    return shards, -(-buckets // shards)


def _gaps(x: np.ndarray, kind=np.uint32) -> np.ndarray:
    return np.diff(x, prepend=0).astype(kind)


def _sums(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)


def _numbered(table: pa.Table) -> pa.Table:
    """Ranks and counts of each block's words of one bucket: from 1 by falling count; 0 for words outside training texts."""
    numbers, mine, counts, gaps = _Numbers(), [], [], []
    for payload in table.column("payload"):
        words, gap, n = unpack(payload.as_py(), "b u4 u8")
        gaps.append(gap)
        mine.append(np.fromiter(map(numbers.__getitem__, words.split(b" ")), np.int64, len(gap)))
        counts.append(n)
    words = list(numbers)
    total = np.bincount(np.concatenate(mine), np.concatenate(counts), len(words)).astype(np.uint64)
    rank = np.zeros(len(words), np.uint32)
    rank[sorted(range(len(words)), key=lambda i: (-int(total[i]), words[i]))] = np.arange(1, len(words) + 1)
    rank[total == 0] = 0
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"),
                     "payload": pa.array([pack(g, rank[m], total[m]) for g, m in zip(gaps, mine)], pa.binary())})


def _lexicon(bucket: pa.ChunkedArray, payloads: list, kinds: str) -> list[np.ndarray]:
    """Of a block's words by number: bucket and the parts after the first (numbers as gaps) of the buckets' payloads."""
    parts = list(zip(*[unpack(p.as_py(), kinds) for p in payloads]))
    at = np.concatenate([_sums(g) for g in parts[0]])
    out = []
    for x in [np.repeat(bucket.to_numpy(), list(map(len, parts[0]))), *map(np.concatenate, parts[1:])]:
        out.append(np.empty(len(at), np.int64 if x.dtype.kind in "iu" else x.dtype))
        out[-1][at] = x
    return out


def _block_pairs(tokens: np.ndarray, bucket: np.ndarray, rank: np.ndarray, buckets: int):
    """Different (word, context) pairs of a block, both known from training: numbers of word and context in the block,
    ordered by the word's bucket, its rank and the context; then the known tokens, and the pair of each.

    Every text ends in number 0, the end, which is also the context at the start.
    """
    before = np.concatenate([[0], tokens[:-1]])
    known = np.flatnonzero((rank[tokens] > 0) & (rank[before] > 0))
    by_word, by_context = np.lexsort((rank, bucket)), np.lexsort((bucket, rank))
    word, context = np.empty_like(by_word), np.empty_like(by_word)
    word[by_word] = context[by_context] = np.arange(len(rank))
    keys, pair = np.unique(word[tokens[known]] * len(rank) + context[before[known]], return_inverse=True)
    return by_word[keys // len(rank)], by_context[keys % len(rank)], known, pair


def _tokens(docs: pa.Table) -> list[np.ndarray]:
    return [unpack(p.as_py(), "u4")[0].astype(np.int64) for p in docs.column("payload")]


def _asked(buckets: int):
    """A block's pairs for the buckets of their words."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        texts = _tokens(docs)
        bucket, rank, _ = _lexicon(words.column("bucket"), words.column("payload"), VOCABULARY)
        word, context, known, pair = _block_pairs(np.concatenate(texts), bucket, rank, buckets)
        train = np.repeat(~docs.column("held").to_numpy(zero_copy_only=False).astype(bool), list(map(len, texts)))
        n = np.bincount(pair[train[known]], minlength=len(word)).astype(np.uint32)
        cuts = np.searchsorted(bucket[word], np.arange(buckets + 1))
        to, out = [], []
        for b, (start, stop) in enumerate(zip(cuts, cuts[1:])):
            if start < stop:
                first = np.flatnonzero(np.diff(word[start:stop], prepend=-1))
                number = rank[context[start:stop]] * buckets + bucket[context[start:stop]]
                gap = np.diff(number, prepend=0)
                gap[first] = number[first]
                to.append(b)
                out.append(pack(_gaps(rank[word[start:stop]][first]), np.diff(first, append=stop - start).astype(np.uint32),
                                gap.astype(np.uint64), n[start:stop]))
        block = docs.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(to, pa.int32()), "block": pa.array([block] * len(to), pa.int64()),
                         "payload": pa.array(out, pa.binary())})

    return run


def _pairs(payload: bytes):
    """Rank of the word, number of the context, and count of each pair."""
    rank, per, gap, n = unpack(payload, PAIRS)
    total, start = _sums(gap), np.cumsum(per, dtype=np.int64) - per
    return np.repeat(_sums(rank), per), total - np.repeat(total[start] - gap[start].astype(np.int64), per), n


def _state_row(bucket: list, *parts: list) -> pa.Table:
    return pa.table([pa.array(bucket, pa.int32()), *[pa.array(x, pa.binary()) for x in parts]],
                    ["bucket", "payload", "contexts", "tables", "back"])


def _merge(buckets: int):
    """All blocks' pairs of a bucket, counts added; every context starts with one table per word."""

    def run(table: pa.Table) -> pa.Table:
        word, context, n = map(np.concatenate, zip(*[_pairs(p.as_py()) for p in table.column("payload")]))
        word, context, n = word[n > 0], context[n > 0], n[n > 0]
        if not len(n):
            return _state_row([], [], [], [], [])
        wide = int(context.max()) + 1
        keys, at = np.unique(word * wide + context, return_inverse=True)
        c = np.bincount(at, n).astype(np.uint32)
        seen, per = np.unique(keys // wide, return_counts=True)
        numbers, ctx = np.unique(keys % wide, return_inverse=True)
        shards, each = _shards(buckets)
        shard, at = numbers % buckets % shards, numbers // buckets * each + numbers % buckets // shards
        order = np.lexsort((at, shard))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        payload = pack(seen.astype("<u4").tobytes(), per.astype(np.uint32), place[ctx].astype(np.uint32), c,
                       np.ones(len(keys), np.uint32), np.zeros(0), np.ones(len(seen), np.uint32), np.zeros(len(seen)))
        contexts = pack(np.bincount(shard, minlength=shards).astype(np.uint32), at[order].astype(np.uint32))
        return _state_row([table.column("bucket")[0].as_py()], [payload], [contexts], [pack(EMPTY)], [pack(EMPTY, EMPTY)])

    return run


def _totals(state: DataFrame) -> dict:
    """Sums of the customers and of the parent, and counts of counts: eight numbers."""
    names = ("customers", "words", "parent", "parent_tables", "c1", "c2", "p1", "p2")

    def run(batches):
        out = np.zeros(len(names))
        for batch in batches:
            for p in batch.column(0):
                _, per, _, c, t, _, r, _ = unpack(p.as_py(), STATE)
                parent = np.add.reduceat(t, np.cumsum(per, dtype=np.int64) - per, dtype=np.int64)
                out += [c.sum(dtype=np.int64), len(per), parent.sum(), r.sum(dtype=np.int64), (c == 1).sum(), (c == 2).sum(),
                        (parent == 1).sum(), (parent == 2).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["k", "v"])

    sums = dict.fromkeys(names, 0.0)
    for k, v in state.select("payload").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
        sums[names[k]] = v
    return sums


def _context_totals(state: DataFrame, buckets: int) -> DataFrame:
    """``bucket, of, payload``: tables of the restaurants each bucket has words in, by the shard ``of`` their context, in the
    order of the state; and, with ``of`` null, those of all contexts whose word is in the bucket."""
    shards, each = _shards(buckets)

    def sent(batches):
        for batch in batches:
            for bucket, p, contexts in zip(batch.column(0), batch.column(1), batch.column(2)):
                _, _, ctx, _, t, *_ = unpack(p.as_py(), STATE)
                per, place = unpack(contexts.as_py(), "u4 u4")
                t = np.bincount(ctx, t, len(place)).astype(np.uint64)
                ends = np.cumsum(per)
                to = np.flatnonzero(per)
                out = [pack(_gaps(place[a:b].astype(np.int64)), t[a:b]) for a, b in zip((ends - per)[to], ends[to])]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([bucket.as_py()] * len(to), pa.int32()),
                                                  pa.array(out, pa.binary())], ["of", "bucket", "payload"])

    def added(table: pa.Table) -> pa.Table:
        place, t = zip(*[unpack(p.as_py(), TOTALS) for p in table.column("payload")])
        place = [_sums(x) for x in place]
        t = np.bincount(np.concatenate(place), np.concatenate(t)).astype(np.uint64)
        of, out = table.column("of")[0].as_py(), [pack(t[x]) for x in place]
        own = [(of + k * shards, np.flatnonzero(t[k::each])) for k in range(each)]
        own = [(b, pack(_gaps(rank), t[b // shards::each][rank])) for b, rank in own if len(rank)]
        return pa.table({"bucket": pa.array([*table.column("bucket").to_pylist(), *[b for b, _ in own]], pa.int32()),
                         "of": pa.array([of] * len(out) + [None] * len(own), pa.int32()),
                         "payload": pa.array([*out, *[p for _, p in own]], pa.binary())})

    return state.select("bucket", "payload", "contexts").mapInArrow(sent, "of int, bucket int, payload binary").groupBy(
        "of").applyInArrow(added, "bucket int, of int, payload binary")


def seat(rng, customers: np.ndarray, new: np.ndarray, step: np.ndarray, discount: float) -> np.ndarray:
    """Tables after the customers sat down one by one: a new table weighs ``new + step * tables``, the others together
    ``seated - discount * tables``. From the 17th customer on they come in groups of a quarter of those seated."""
    tables = np.minimum(customers, 1).astype(np.int64)
    at, seated = np.flatnonzero(customers > 1), 1
    while len(at):
        group = 1 if seated < 16 else seated // 4
        more = np.minimum(customers[at] - seated, group)
        t = tables[at]
        fresh = new[at] + step[at] * t
        chance = fresh / (fresh + np.maximum(seated + (more - 1) / 2 - discount * t, 0.0))
        tables[at] += rng.random(len(at)) < chance if group == 1 else rng.binomial(more, chance)
        seated += group
        at = at[customers[at] > seated]
    return tables


def _parent(count, tables, sums, d0):
    """The parent's prediction for words with these customers and tables."""
    back = (STRENGTH + d0 * sums["parent_tables"]) / (STRENGTH + sums["parent"])
    return np.maximum(count - d0 * tables, 0) / (STRENGTH + sums["parent"]) + back / (sums["words"] + 1)


def sweep(payload: bytes, sums: dict, d0: float, d1: float, keep: bool, move: bool, seed: tuple) -> bytes:
    """One bucket's state after adding its present predictions (``keep``) and seating everybody anew (``move``).

    ``sums``: of the parent, and tables ``t`` per context; with customers ``c`` per context own shares are added as well.
    """
    words, per, ctx, c, t, own, r, up = unpack(payload, STATE)
    if not len(per):
        return payload
    starts = np.cumsum(per, dtype=np.int64) - per
    row = np.repeat(np.arange(len(per)), per)
    c, t, r = c.astype(np.int64), t.astype(np.int64), r.astype(np.int64)
    count = np.add.reduceat(t, starts)
    if keep:
        if "c" in sums:
            own = own + (c - d1 * t) / (STRENGTH + sums["c"][ctx])
        up = up + _parent(count, r, sums, d0)
    if move:
        rng = np.random.default_rng(seed)
        rest = count[row] - t  # the word's tables from other contexts
        p = _parent(rest, np.minimum(r[row], rest), sums, d0)
        t = seat(rng, c, (STRENGTH + d1 * (sums["t"][ctx] - t)) * p, d1 * p, d1)
        count = np.add.reduceat(t, starts)
        base = np.full(len(per), 1 / (sums["words"] + 1))
        r = seat(rng, count, (STRENGTH + d0 * (sums["parent_tables"] - r)) * base, d0 * base, d0)
    return pack(words, per, ctx, c.astype(np.uint32), t.astype(np.uint32), own, r.astype(np.uint32), up)


def _swept(state: DataFrame, buckets: int, sums: dict, d0: float, d1: float, keep: bool, move: bool, *, seed: int) -> DataFrame:
    def run(rows: pa.Table, totals: pa.Table) -> pa.Table:
        if not len(rows):
            return rows
        bucket, payload, contexts, tables, back = (rows.column(k)[0].as_py() for k in rows.column_names)
        of = np.array(totals.column("of").fill_null(-1).to_pylist())
        parts = totals.column("payload").take(pa.array(np.argsort(of)[(of < 0).sum():]))
        t = np.concatenate([unpack(p.as_py(), "u8")[0] for p in parts]).astype(np.int64)
        if keep:
            now, before = unpack(payload, STATE)[4], unpack(tables, "u4")[0]
            tables = pack(now + before if len(before) else now)
            for p in totals.filter(pa.array(of < 0)).column("payload"):
                rank, now = unpack(p.as_py(), TOTALS)
                before = unpack(back, TOTALS)[1]
                back = pack(rank, now + before if len(before) else now)
        payload = sweep(payload, {**sums, "t": t}, d0, d1, keep, move, (SEED, seed, bucket))
        return _state_row([bucket], [payload], [contexts], [tables], [back])

    return state.groupBy("bucket").cogroup(_context_totals(state, buckets).groupBy("bucket")).applyInArrow(run, STATE_ROW)


ANSWER = "u4 u4 u8 f4 u8"  # VOCABULARY, then the parent's prediction and, for the word as context, the summed tables


def _answers(samples: int, buckets: int):
    """Per block: counts and averaged predictions of its words of a bucket, and customers and summed tables (less one a
    sample) of its pairs, in their order."""

    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        if not len(state):  # nothing of this bucket is in training texts
            words, per, ctx, c, tables, up, numbers, of, back = [np.zeros(0, np.int64)] * 9
        else:
            words, per, ctx, c, _, _, _, up = unpack(state.column("payload")[0].as_py(), STATE)
            words = np.frombuffer(words, "<u4").astype(np.int64)
            shards, each = _shards(buckets)
            per_shard, place = unpack(state.column("contexts")[0].as_py(), "u4 u4")
            rank, number = np.divmod(place.astype(np.int64), each)
            numbers = rank * buckets + number * shards + np.repeat(np.arange(shards), per_shard)
            tables = unpack(state.column("tables")[0].as_py(), "u4")[0] - samples
            of, back = unpack(state.column("back")[0].as_py(), TOTALS)
            of = _sums(of)
        size = int(words.max()) + 1 if len(words) else 1
        above, share = np.zeros(size, np.float32), np.zeros(size, np.uint64)
        above[words], share[of] = up / samples, back
        wide = int(numbers.max()) + 1 if len(numbers) else 1
        keys = np.repeat(words, per) * wide + numbers[ctx]
        out = []
        for kind, payload in zip(asked.column("kind").to_pylist(), asked.column("payload")):
            if kind == 1:
                gaps, rank, n = unpack(payload.as_py(), VOCABULARY)
                out.append(pack(gaps, rank, n, above[rank], share[rank]))
            else:
                word, context, _ = _pairs(payload.as_py())
                seen, more = np.zeros(len(word), np.uint32), np.zeros(len(word), np.uint32)
                if len(keys):
                    want = word * wide + context
                    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    hit = (keys[at] == want) & (context < wide)
                    seen[hit], more[hit] = c[at[hit]], tables[at[hit]]
                out.append(pack(seen, more))
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "kind": asked.column("kind"),
                         "payload": pa.array(out, pa.binary())})

    return run


def _scored(sums: dict, buckets: int, samples: int, d1: float, unknown: float, total: int, id_type: str):
    """Scores of a block's documents from the answers of all buckets."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        words, pairs = (answers.filter(pa.array(answers.column("kind").to_numpy() == k)) for k in (1, 2))
        bucket, rank, counts, above, tables = _lexicon(words.column("bucket"), words.column("payload"), ANSWER)
        parent = np.where(counts > 0, above.astype(np.float64), unknown)
        texts = _tokens(docs)
        tokens, sizes = np.concatenate(texts), np.array(list(map(len, texts)))
        _, context, known, pair = _block_pairs(tokens, bucket, rank, buckets)
        c, more = map(np.concatenate, zip((EMPTY, EMPTY), *[unpack(p.as_py(), "u4 u4") for p in pairs.column("payload")]))
        # a word has as many customers in its restaurant as it has training tokens: each has a next one
        own = (c - d1 * ((c > 0) + more / samples)) / (STRENGTH + counts[context])
        back = (STRENGTH + d1 * tables / samples) / (STRENGTH + counts)
        p = back[np.concatenate([[0], tokens[:-1]])] * parent[tokens]
        p[known] += own[pair]
        plain = np.log10((counts + 1) / (total + sums["words"] + 1))
        starts = np.cumsum(sizes) - sizes
        seen, base, score = (np.add.reduceat(x, starts) for x in ((counts[tokens] > 0).astype(np.int64), plain[tokens], np.log10(p)))
        return pa.table({
            "id": docs.column("id"), "held_out": docs.column("held"), "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(seen, pa.int64()), "train_tokens": pa.array([total] * len(sizes), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold: int = 2, of: int = 7,
          burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A document is held out of training if crc32 of its id as text (null: empty text) mod ``of`` is ``fold``. Tokens are
    words after lower-casing A-Z, and one end per text, so a null or empty text is one token. ``base_score`` is the base-10
    logarithm of the text's probability under counts with one added, ``score`` under the model, the average prediction of
    ``samples`` seatings; for both all unknown words are one word. Rows that repeat count and come out as often as they
    come in; without training rows both scores are 0 for every token. An empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = 2 * width(spark)
    rows = stored(encode(docs, id_col, text_col, buckets, fold, of), "encoded", partition_by="kind")
    message = "bucket int, block long, payload binary"
    texts = rows.where("kind = 0").select("block", "held", "payload", "id")
    words = stored(rows.where("kind = 1").select("bucket", "block", "payload").groupBy("bucket").applyInArrow(
        _numbered, message), "words")
    pairs = stored(texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_asked(buckets), message), "pairs")
    state = stored(pairs.groupBy("bucket").applyInArrow(_merge(buckets), STATE_ROW), "state")
    sums = _totals(state)
    d1, d0 = _discount(sums["c1"], sums["c2"]), _discount(sums["p1"], sums["p2"])
    unknown, total = 0.0, int(sums["customers"])
    for k in range(burn_in + samples):
        keep, move = k >= burn_in, k + 1 < burn_in + samples
        if keep:
            unknown += float(_parent(0, 0, sums, d0)) / samples
        new = stored(_swept(state, buckets, sums, d0, d1, keep, move, seed=k), "state")
        dropped(state)
        state = new
        if move:
            sums = _totals(state)
    asked = words.withColumn("kind", F.lit(1)).unionByName(pairs.withColumn("kind", F.lit(2)))
    answers = stored(asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(
        _answers(samples, buckets), "block long, bucket int, kind int, payload binary"), "answers")
    dropped(words, pairs, state)
    run, schema = _scored(sums, buckets, samples, d1, unknown, total, docs.schema[id_col].dataType.simpleString())
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
