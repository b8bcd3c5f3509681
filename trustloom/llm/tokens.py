"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A state is what the rest of a text can still depend on: the Aho-Corasick node, and for each piece that may have begun at
one of the last positions, the last token before that position and how many tokens fewer were emitted there. A
transition reads one character and carries the number of tokens it adds (also 0 or less, when characters join). States
and transitions are compiled when first met; a state has one successor per character, so the transducer is
deterministic, and its counts are those of the merges.

A text is cut into chunks. The map of a chunk from the state before it to the state after it needs only three parts,
because a space after another character always leads back to the start: what stands before the chunk's first such border,
the tokens between its borders, and what stands after its last one. Maps are composed pairwise, level by level, as in a
parallel prefix scan; composition is associative, so chunks can be counted in any order and place.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trustloom.llm.pieces import MARK, Units, Vocabulary, _no_line_end, automaton, spaced_text, unit_results

CHUNK = 1 << 18
STATES = 200_000  # the transducer is compiled anew when it has so many states

_BORDER = re.compile(r"(?<=[^ ]) ")


class Transducer:
    def __init__(self, v: Vocabulary):
        self.auto = automaton(v)
        self._clear()

    def _clear(self):
        self.ids, self.states, self.hops = {}, [], []
        self._state((0, ((0, -1, 0),)))

    def _state(self, key) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.hops.append({})
        return self.ids[key]

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        """Next state and tokens added when ``c`` is read."""
        a = self.auto
        node, live = self.states[state]
        if c not in a.chars:
            hop = 0, len(c.encode())
        else:
            open_at = {k: (last, n) for k, last, n in live}
            to = a.step(node, c)
            piece, size = next((p, m) for p, m in a.ends[to] if a.fit(open_at[m - 1][0], p))
            added = open_at[size - 1][1] + 1
            live, at = [(0, piece, 0)], to
            while at:
                if a.next[at]:
                    last, n = open_at[a.depth[at] - 1]
                    live.append((a.depth[at], last, n - added))
                at = a.fail[at]
            hop = self._state((to, tuple(sorted(live)))), added
        self.hops[state][c] = hop
        return hop

    def count(self, text: str) -> int:
        """Tokens of a text whose spaces are written as marks."""
        if len(self.states) > STATES:
            self._clear()
        state, total, hops = 0, 0, self.hops
        for c in text:
            state, added = hops[state].get(c) or self._compile(state, c)
            total += added
        return total


class Counter:
    """Counts tokens of whole texts; one per vocabulary and worker process."""

    def __init__(self, v: Vocabulary):
        machine = Transducer(v)
        self.bare = Units(machine.auto, machine.count, sum, "")
        self.spaced = Units(machine.auto, machine.count, sum, MARK, self.bare.parts)

    def tokens(self, text: str) -> int:
        """Tokens of a stretch between borders."""
        return sum(unit_results(text, self.bare, self.spaced, 1))

    def chunk_map(self, text: str):
        """(before the first border, tokens between the borders or None without a border, after the last border)."""
        first = _BORDER.search(text)
        if not first:
            return text, None, ""
        last = text.rindex(" ")
        while text[last - 1] == " ":
            last -= 1
        return text[:first.start()], self.tokens(text[first.start():last]), text[last:]

    def compose(self, a, b):
        """The map of two neighbouring chunks; associative."""
        open_left = a[1] is None
        met = self.chunk_map((a[0] if open_left else a[2]) + b[0])  # has a border only where the chunks meet
        if open_left and met[1] is None:
            return (met[0], *b[1:])
        if open_left:
            return met if b[1] is None else (met[0], met[1] + self.tokens(met[2]) + b[1], b[2])
        if b[1] is not None:
            return a[0], a[1] + self.tokens(a[2] + b[0]) + b[1], b[2]
        return (*a[:2], met[0]) if met[1] is None else (a[0], a[1] + self.tokens(met[0]) + met[1], met[2])

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        text = spaced_text(text)
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)] or [("", None, "")]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, between, tail = maps[0]
        return self.tokens(head) + (between or 0) + self.tokens(tail)


_COUNTERS: dict[str, Counter] = {}


def counter(v: Vocabulary) -> Counter:
    if v.key not in _COUNTERS:
        _COUNTERS[v.key] = Counter(v)
    return _COUNTERS[v.key]


def token_counts(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", *,
                 limit: int = 4096) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row: bytes as UTF-8, tokens as the model's library counts them.

    Null text counts as empty: 0 bytes, 0 tokens. Strings of special tokens inside a text are ordinary text. Rows that
    repeat come out as often as they come in, an empty table stays empty; other columns are not read.
    """
    _no_line_end(v)

    def run(batches):
        machine = counter(v)
        for batch in batches:
            n = [machine.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    counted = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                          text.alias("body")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
