"""Packing of token sequences into as few sequences of a fixed size as can be found, by bin completion.

Tokenised documents are cut into pieces of at most ``size`` ids. How the pieces fit together depends only on how many
there are of each length, so the plan is made from that histogram: at most ``size`` counts, whatever the input. Its
result is a list of fillings (lengths that share a sequence) with multiplicities. Pieces find their place by their rank
among the pieces of their length; ranks are counted per partition and shifted by per-partition totals, so no task holds
all pieces of a length.
"""

from __future__ import annotations

import json
import re
import zlib
from struct import Struct, pack as packed_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trustloom.llm.common import dropped, stored

SIZE, END = 1024, 2
NODES = 2000  # fillings the search may try; the best-fit plan stands where it finds nothing better
MEMO = 300_000  # kept parts of a memo, in two generations: the older one goes when the younger is full


def _units_are_apart(tokenizer: str) -> bool:
    """Whether ids of a text are the ids of its parts cut before each space that another character follows: so for
    byte-level tokenizers with the usual pattern and no normaliser."""
    spec = json.loads(tokenizer)
    pre = spec.get("pre_tokenizer") or {}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and pre.get("use_regex", True) and not any(c.isspace() for t in added for c in t))


# Letters, then punctuation without apostrophes: the pattern cuts between them wherever they stand.
_WORD_MARKS = re.compile(r"([^\W\d_]+)([^\w\s']+)")


_ENDS = frozenset(".,;:!?")


class _Ids(dict):
    """Ids of a part (as little-endian bytes) with ``lead`` before it, computed by the tokenizer at first use. Parts are
    put together from smaller ones where the pattern cuts anyway: around a line end between two characters, and between
    letters and the marks after them."""

    def __init__(self, encode, encode_word, lead: str = " ", bare: _Ids | None = None):
        super().__init__()
        self.encode, self.encode_word, self.lead, self.bare = encode, encode_word, lead, self if bare is None else bare
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if part[-1:] in _ENDS and (word := part[:-1]).isalpha():  # as cheap as looking it up, so not kept
            return self[word] + self.bare[part[-1]]
        if len(self) >= MEMO // 2:
            self.old = dict(self)
            self.clear()
        got = self.old.get(part)
        if got is not None:
            pass
        elif part.isalpha():
            got = self.encode_word(self.lead, part)
        elif not part or part[0].isspace():  # runs of white space are not cut
            raise KeyError(part)
        elif (word := _WORD_MARKS.fullmatch(part)) and word[1].isalpha():
            got = self[word[1]] + self.bare[word[2]]
        else:
            before, line, after = part.partition("\n")
            if line and after and not (before[-1].isspace() or after[0].isspace()):
                got = self[before] + self.bare.lines + self.bare[after]
            else:
                got = self.encode(self.lead + part)
        self[part] = got
        return got


def _byte_letters() -> dict[int, str]:
    """How byte-level models write bytes: visible ones as themselves, the others as the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_MEMOS: dict[str, tuple[_Ids, _Ids]] = {}


def _memos(tokenizer: str) -> tuple[_Ids, _Ids]:
    """Ids of parts without and with a space before them; one pair per tokenizer and worker process."""
    if tokenizer not in _MEMOS:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer)
        tokenize, letters = tok.model.tokenize, str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        leads, packs = {x: x.translate(letters) for x in ("", " ")}, [Struct(f"<{n}I").pack for n in range(64)]

        def encode(text):
            return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        def encode_word(lead, word):  # the pattern leaves it whole, so only the tokenizer's merges are needed
            if not word.isascii():  # letters of ASCII are written as themselves
                word = word.encode().decode("latin-1").translate(letters)
            ids = [t.id for t in tokenize(leads[lead] + word)]
            return packs[len(ids)](*ids) if len(ids) < len(packs) else packed_ids(f"<{len(ids)}I", *ids)

        bare = _Ids(encode, encode_word, "")
        bare.lines = encode("\n")
        _MEMOS[tokenizer] = bare, _Ids(encode, encode_word, " ", bare)
    return _MEMOS[tokenizer]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, size: int = SIZE,
                 end: int = END, checksums: bool = False) -> DataFrame:
    """``id, piece, start, length, ids`` per piece: the ids of a text by the tokenizer (its JSON), then ``end``, cut into pieces.

    Only documents of more than ``size`` ids are cut: all pieces have ``size`` ids, but the first takes what is left over.
    ``ids`` are little-endian unsigned 32-bit; with ``checksums`` their CRC-32, ``ids_crc32``, stands in their place. Null text counts as empty and gives the ``end`` id alone; rows that repeat
    come out as often as they come in; an empty table stays empty.
    """
    apart, (name, kept) = _units_are_apart(tokenizer), ("ids_crc32", "long") if checksums else ("ids", "binary")

    def run(batches):
        bare, spaced = _memos(tokenizer)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                try:
                    if not apart:
                        raise KeyError
                    first, *rest = text.split(" ")
                    ids = b"".join([bare[first] if first else b"", *map(spaced.__getitem__, rest), last])
                except KeyError:
                    ids = bare.encode(text) + last
                n = len(ids) // 4
                head = n % size or size
                cuts = [0, *range(head, n + 1, size)]
                rows += [(k, p, a, b - a, ids[4 * a:4 * b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            k, p, a, n, ids = zip(*rows) if rows else ((),) * 5
            last_column = pa.array(map(zlib.crc32, ids), pa.int64()) if checksums else pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(k, pa.int64())), pa.array(p, pa.int32()), pa.array(a, pa.int64()),
                 pa.array(n, pa.int64()), last_column], ["id", "piece", "start", "length", name])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, {name} {kept}")


Plan = list[tuple[tuple[int, ...], int]]  # lengths that share a sequence, number of such sequences


def best_fit(counts: np.ndarray, size: int) -> Plan:
    """Best-fit decreasing on counts per length; equal sequences are handled together."""
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]  # by what is left
    for length in range(size, 0, -1):
        left = int(counts[length])
        for free in range(length, size + 1):
            while left and room[free]:
                filling, n = room[free].popitem()
                each = free // length
                full, rest = divmod(left, each)
                took = min(n, full)
                if took:
                    key, to = filling + (length,) * each, room[free - each * length]
                    to[key] = to.get(key, 0) + took
                    left, n = left - took * each, n - took
                if n and full <= took and rest and left:
                    key, to = filling + (length,) * left, room[free - left * length]
                    to[key] = to.get(key, 0) + 1
                    left, n = 0, n - 1
                if n:
                    room[free][filling] = room[free].get(filling, 0) + n
            if not left:
                break
        if left:
            each = size // length
            full, rest = divmod(left, each)
            for k, n in ((each, full), (rest, 1)):
                if k and n:
                    key, to = (length,) * k, room[size - k * length]
                    to[key] = to.get(key, 0) + n
    return [(f, n) for groups in room for f, n in groups.items()]


def fillings(counts: np.ndarray, room: int, limit: int = 8) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from the counts, least waste first, at most ``limit``.

    A filling is dominated if one of its items, or two together, can be exchanged for one larger item that still fits;
    then the other filling leaves smaller items for later sequences.
    """
    lengths = np.flatnonzero(counts[:room + 1])[::-1].tolist()
    if not lengths:
        return [()]
    if lengths[0] == room:  # one item without waste dominates every other filling
        return [(room,)]
    there = np.array(lengths[::-1])

    def larger(low: int, high: int) -> bool:
        """Whether there is an item with low < length <= high."""
        return np.searchsorted(there, high, "right") > np.searchsorted(there, low, "right")

    found: dict[tuple[int, ...], int] = {}

    def search(chosen: tuple[int, ...], at: int, free: int, tries: list[int]) -> None:
        tries[0] -= 1
        smallest = int(there[0])
        if free < smallest or at >= len(lengths):
            bad = any(larger(x, x + free) for x in set(chosen)) or any(
                larger(x + y - 1, x + y + free) for i, x in enumerate(chosen) for y in chosen[i + 1:])
            if chosen and not bad:
                found[chosen] = free
            return
        for i in range(at, len(lengths)):
            if tries[0] <= 0 or len(found) >= 4 * limit or (found and not min(found.values())):
                return
            if lengths[i] <= free and counts[lengths[i]] > chosen.count(lengths[i]):
                search((*chosen, lengths[i]), i, free - lengths[i], tries)

    search((), 0, room, [400])
    if not found:  # everything left together
        out, free = [], room
        for x in lengths:
            k = min(int(counts[x]), free // x)
            out, free = out + [x] * k, free - k * x
        found[tuple(out)] = free
    return sorted(found, key=found.get)[:limit]


def bin_completion(counts: np.ndarray, size: int, nodes: int = NODES) -> Plan:
    """A plan with as few sequences as found: best fit is the incumbent, then branch and bound over fillings of the
    sequence that holds the largest piece left. A branch ends where its waste allows no fewer sequences than the incumbent;
    the search ends when the sum of lengths proves the incumbent best, or after ``nodes`` fillings.
    """
    counts = counts.astype(np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    lower = -(-total // size)
    plan = best_fit(counts, size)
    used = sum(n for _, n in plan)
    stack = [(counts, (), 0)]
    while stack and used > lower and nodes > 0:
        left, path, waste = stack.pop()
        nodes -= 1
        if waste > (used - 1) * size - total:
            continue
        if not left.any():
            plan, used = [], 0
            while path:
                path, step = path
                plan.append(step)
                used += step[1]
            continue
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        for filling in reversed(fillings(rest, size - largest)):
            whole = (largest, *filling)
            items, each = np.unique(whole, return_counts=True)
            times = int((left[items] // each).min())
            after = left.copy()
            after[items] -= times * each
            stack.append((after, (path, (whole, times)), waste + times * (size - sum(whole))))
    return plan


def pack(pieces: DataFrame, *, size: int = SIZE, nodes: int = NODES) -> DataFrame:
    """``pieces`` (any columns, ``length`` from 1 to ``size``) with ``sequence_id`` and ``offset``: pieces that share a
    sequence lie one after another from offset 0. An empty table stays empty; a null or other length ends the job with an error.
    """
    if clash := {"sequence_id", "offset", "_part", "_row", "_rank"} & set(pieces.columns):
        raise ValueError(f"columns {sorted(clash)} are made here")
    rows = stored(pieces.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "pieces")
    sums = stored(rows.groupBy("length", "_part").agg(F.count("*").alias("n")), "sums")
    counts = np.zeros(size + 1, np.int64)
    for length, n in sums.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        if length is None or not 0 < length <= size:
            raise ValueError(f"a piece has length {length}, not 1 to {size}")
        counts[length] = n
    plan = bin_completion(counts, size, nodes)
    dealt = np.zeros(size + 1, np.int64)
    keys, table, sequence = [], [], 0
    for filling, times in plan:
        at = 0
        for length, each in sorted({x: filling.count(x) for x in filling}.items(), reverse=True):
            keys.append((length << 44) + int(dealt[length]))
            table.append((int(dealt[length]), sequence, times, at))
            dealt[length] += times * each
            at += length * each
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    keys, table = np.array(keys, np.int64)[order], np.array(table, np.int64).reshape(-1, 4)[order]

    def place(batches):
        for batch in batches:
            n = batch.num_columns - 1  # the rank is last
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column(n).to_numpy(zero_copy_only=False)
            first, sequence, times, at = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1].T
            copy, which = np.divmod(rank - first, times)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sequence + which), pa.array(at + copy * length)],
                                             [*batch.schema.names[:n], "sequence_id", "offset"])

    before = sums.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("length").alias("_length"), F.col("_part").alias("_of"), F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("_part", "length").orderBy("_row")) - 1
    ranked = rows.withColumn("_rank", inside.cast("long")).join(
        before, (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_of"))).select(
        *[F.col(f"`{c}`") for c in pieces.columns], (F.col("_rank") + F.col("before")).cast("long").alias("_rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
