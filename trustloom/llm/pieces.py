"""SentencePiece vocabularies: an Aho-Corasick automaton over the pieces, Viterbi encoding over it, and decoding.

``Automaton`` walks a text once. At each position it follows the output links to every piece that ends there and relaxes
the best way to reach the position. For a unigram model the best way has the largest sum of scores. For a BPE model a
way is open only if the merges would leave the two neighbouring pieces as they are (checked once per pair and kept);
exactly one way is then open at each position, and it is the one the merges produce.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"  # stands for a space inside pieces
MEMO = 300_000  # kept units
HEAD = 6  # characters of a text whose ways are kept, since many texts begin alike


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores. ``bytes_at``: id of each byte piece; ``plain``: ids of pieces that match text."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[int, ...]
    bytes_at: tuple[int, ...]
    kind: str  # "bpe" or "unigram"
    key: str


def read_vocabulary(path: str, kind: str = "bpe") -> Vocabulary:
    """The pieces of a SentencePiece model file, read on the driver; tasks get them with their closure."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, scores = tuple(map(sp.id_to_piece, range(n))), tuple(map(sp.get_score, range(n)))
    plain = tuple(i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))
    return vocabulary(pieces, scores, plain, tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)), kind)


def vocabulary(pieces, scores, plain, bytes_at, kind) -> Vocabulary:
    chars = {pieces[i] for i in plain if len(pieces[i]) == 1}
    if lost := {c for i in plain for c in pieces[i]} - chars:
        raise ValueError(f"characters without a piece of their own: {sorted(lost)[:5]}")
    if any(MARK in pieces[i].lstrip(MARK) for i in plain):
        raise ValueError("pieces that cross a space are not supported")
    key = hashlib.sha256(repr((pieces, scores, plain, kind)).encode()).hexdigest()
    return Vocabulary(tuple(pieces), tuple(scores), tuple(plain), tuple(bytes_at), kind, key)


class Automaton:
    """Aho-Corasick automaton over the plain pieces; node 0 is the root."""

    def __init__(self, v: Vocabulary):
        self.v, self.next, self.piece, self.depth = v, [{}], [-1], [0]
        self.rank = {v.pieces[i]: (v.scores[i], i) for i in v.plain}
        self.chars = {p for p in self.rank if len(p) == 1}
        often = Counter(x for x, _ in self.rank.values())
        own = sorted((p for p, (x, _) in self.rank.items() if len(p) > 1 and often[x] == 1), key=lambda p: -self.rank[p][0])
        self.order, self.split = {p: i for i, p in enumerate(own)}, {}
        self.fits: dict[int, bool] = {}
        self.heads: dict[str, tuple[int, list[int], list[int]]] = {}
        for p, (_, i) in self.rank.items():
            at = 0
            for c in p:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(-1)
                    self.depth.append(self.depth[at] + 1)
                at = self.next[at][c]
            self.piece[at] = i
        self.fail, self.link = [0] * len(self.next), [0] * len(self.next)  # link: nearest suffix that is a piece
        queue = list(self.next[0].values())
        for at in queue:
            for c, to in self.next[at].items():
                f = self.fail[at]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                self.fail[to] = self.next[f].get(c, 0)
                queue.append(to)
            self.link[at] = self.fail[at] if self.piece[self.fail[at]] >= 0 else self.link[self.fail[at]]
        self.ends = []  # per node, the pieces that end there with their lengths, longest first: the output links followed
        for at in range(len(self.next)):
            node, out = at if self.piece[at] >= 0 else self.link[at], []
            while node:
                out.append((self.piece[node], self.depth[node]))
                node = self.link[node]
            self.ends.append(tuple(out))
        self.hops: list[dict[str, int]] = [{} for _ in self.next]  # steps taken so far, failures included
        self.inside = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}  # neighbours that some piece holds

    def step(self, at: int, c: str) -> int:
        """Next node: the longest piece beginning that ends with this character."""
        to = self.hops[at].get(c)
        if to is None:
            node = at
            while node and c not in self.next[node]:
                node = self.fail[node]
            to = self.hops[at][c] = self.next[node].get(c, 0) if c in self.chars else 0
        return to

    def cut(self, text: str) -> list[str]:
        """Parts of a text that can be encoded apart, since no piece holds the two characters where they meet."""
        at = [0, *[i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.inside], len(text)]
        return [text[i:j] for i, j in zip(at, at[1:])]

    def merged(self, text: str, trace: list | None = None) -> list[str]:
        """What the merges make of a short text: best score first, the leftmost of equal ones."""
        s = list(text)
        while True:
            found = [(-self.rank[s[i] + s[i + 1]][0], i) for i in range(len(s) - 1) if s[i] + s[i + 1] in self.rank]
            if not found:
                return s
            i = min(found)[1]
            if trace is not None:
                trace.append((s[i], s[i + 1]))
            s[i:i + 2] = [s[i] + s[i + 1]]

    def halves(self, piece: str):
        """The two parts of a piece's last merge, if it and its parts come about in the order of their scores; else None."""
        if piece not in self.split:
            trace: list[tuple[str, str]] = []
            whole = self.merged(piece, trace) == [piece]
            parts = trace[-1] if whole and trace else ("", "")
            ok = whole and self.merge_order(piece) >= 0 and all(
                len(x) == 1 or self.halves(x) and self.merge_order(x) < self.merge_order(piece) for x in parts)
            self.split[piece] = parts if ok else None
        return self.split[piece]

    def merge_order(self, piece: str) -> int:
        """Place of a piece among the merges; -1 for characters and for pieces whose score is not their own."""
        return self.order.get(piece, -1)

    def fit(self, left: int, right: int) -> bool:
        """Whether the merges leave piece ``right`` as it is after piece ``left`` (-1: nothing that it could merge with)."""
        key = left * len(self.v.pieces) + right
        if (got := self.fits.get(key)) is None:
            a, b = self.v.pieces[left] if left >= 0 else "", self.v.pieces[right]
            if len(self.fits) >= 4 * MEMO:
                self.fits.clear()
            if a and all(len(x) == 1 or self.halves(x) for x in (a, b)):
                got = self._apart(a, b)
            else:
                got = self.merged(a + b) == ([a, b] if a else [b])
            self.fits[key] = got
        return got

    def _apart(self, a: str, b: str) -> bool:
        """Whether no merge joins the end of ``a`` with the beginning of ``b``: their merges are undone, last first, and
        at each point a merge across the border must come later than the one undone, or not exist."""
        limit, x, y, whole = len(self.order), self.merge_order(a), self.merge_order(b), (a, b)
        while True:
            met = a + b
            if met in self.rank:
                place = self.merge_order(met)
                if place < 0:  # pieces of equal scores: only the merges themselves tell
                    return self.merged("".join(whole)) == list(whole)
                if place < limit:
                    return False
            if x > y:
                limit, a = x, self.halves(a)[1]
                x = self.merge_order(a)
            elif y >= 0:
                limit, b = y + 1, self.halves(b)[0]
                y = self.merge_order(b)
            else:
                return True

    def _walk(self, text: str, start: int, at: int, last: list[int], size: list[int]) -> int:
        """The node reached from ``at`` by the text from ``start`` on; the open way to each position is added to ``last``, ``size``."""
        step, hops, ends, known, n = self.step, self.hops, self.ends, self.fits.get, len(self.v.pieces)
        for i in range(start, len(text)):
            c = text[i]
            to = hops[at].get(c)
            at = step(at, c) if to is None else to
            for p, m in ends[at]:
                left = last[i + 1 - m]
                ok = known(left * n + p)
                if ok or ok is None and self.fit(left, p):
                    last.append(p)
                    size.append(m)
                    break
            else:
                last.append(-1)
                size.append(1)
        return at

    def encode(self, text: str) -> list[int]:
        """Ids of a text whose spaces are written as marks, in one pass."""
        v = self.v
        last, size = [-1], [0]  # the best last piece up to each position, and its length
        step, ends, at = self.step, self.ends, 0
        if v.kind == "bpe":
            if len(text) <= HEAD:
                self._walk(text, 0, 0, last, size)
            else:
                if (head := self.heads.get(text[:HEAD])) is None:
                    if len(self.heads) >= MEMO // 6:
                        self.heads.clear()
                    at = self._walk(text[:HEAD], 0, 0, last, size)
                    head = self.heads[text[:HEAD]] = at, last, size
                at, last, size = head[0], head[1][:], head[2][:]
                self._walk(text, HEAD, at, last, size)
        else:
            unknown, best = min((v.scores[i] for i in v.plain), default=0.0) - 10, [0.0]
            for i, c in enumerate(text, 1):
                at = step(at, c)
                found = max(((best[i - m] + v.scores[p], m, p) for p, m in ends[at]), default=(best[-1] + unknown, 1, -1))
                for x, to in zip(found, (best, size, last)):
                    to.append(x)
        ids, i = [], len(text)
        while i:
            ids += [last[i]] if last[i] >= 0 else [v.bytes_at[b] for b in reversed(text[i - 1].encode())]
            i -= size[i]
        return ids[::-1]


_AUTOMATA: dict[str, Automaton] = {}


def automaton(v: Vocabulary) -> Automaton:
    """One automaton per vocabulary and worker process."""
    if v.key not in _AUTOMATA:
        _AUTOMATA[v.key] = Automaton(v)
    return _AUTOMATA[v.key]


class Memo(dict):
    """Values in two generations of at most ``MEMO / 2`` each: when the younger one is full it becomes the older, and what is asked
    for again moves back to the younger. So frequent keys stay, and rare ones make room."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def put(self, key, value):
        if len(self) >= MEMO // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Units(Memo):
    """Result per unit, computed at first use: that of its parts (see :meth:`Automaton.cut`) by ``fn``, put together by
    ``join``. A unit is a run of spaces and what follows up to the next space or line end: no piece crosses its borders, so
    units are encoded apart. ``lead`` stands before every key."""

    def __init__(self, auto: Automaton, fn, join, lead: str, parts: Memo | None = None):
        super().__init__()
        self.auto, self.fn, self.join, self.lead, self.parts = auto, fn, join, lead, Memo() if parts is None else parts

    def _part(self, part: str):
        got = self.parts.get(part)
        if got is None:
            got = self.parts.old.get(part)
            got = self.parts.put(part, self.fn(part) if got is None else got)
        return got

    def __missing__(self, unit: str):
        out = self.old.get(unit)
        if out is None:
            found = [self._part(part) for part in self.auto.cut(self.lead + unit.replace(" ", MARK))]
            out = self.join(found) if len(found) != 1 else found[0]
        return self.put(unit, out)


def unit_results(text: str, bare: Units, spaced: Units, newline) -> list:
    """Results of all units of a text in order, with ``newline`` between lines. Needs a vocabulary without a line end."""
    out = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append(newline)
        if not line:
            continue
        if "  " in line or line[-1] == " ":  # runs of spaces, each with the word behind it
            at = 0
            while at < len(line):
                word = at
                while word < len(line) and line[word] == " ":
                    word += 1
                stop = line.find(" ", word)
                stop = len(line) if stop < 0 else stop
                out.append(bare[line[at:stop]])
                at = stop
        else:
            first, *rest = line.split(" ")
            if first:
                out.append(bare[first])
            out += map(spaced.__getitem__, rest)
    return out


def spaced_text(text: str | None) -> str:
    """The text with one space in front, as the models want it; null and empty texts stay empty.

    To the models the mark itself is a space.
    """
    return (" " + text).replace(MARK, " ") if text else ""


def _no_line_end(v: Vocabulary) -> None:
    if any("\n" in v.pieces[i] for i in v.plain):
        raise ValueError("pieces with line ends are not supported")


def decode(v: Vocabulary, ids) -> str:
    """Text of ids: byte pieces are joined to UTF-8 (bad bytes become U+FFFD), marks become spaces, the first space goes."""
    byte = {i: bytes([b]) for b, i in enumerate(v.bytes_at)}
    plain = {i: v.pieces[i].replace(MARK, " ").encode() for i in v.plain}
    out = b"".join([plain.get(i) or byte.get(i, b"") for i in ids]).decode("utf-8", "replace")
    return out[1:] if out[:1] == " " else out


def encode_table(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` (little-endian unsigned 32-bit ids) of every row. Null text counts as empty and has no ids.

    Spaces are written as marks and one is put in front, other characters stay; characters without a piece become their
    UTF-8 byte pieces. Rows that repeat come out as often as they come in, an empty table stays empty.
    """
    _no_line_end(v)

    def run(batches):
        a = automaton(v)

        def ids(unit):
            return np.array(a.encode(unit), "<u4").tobytes()

        bare = Units(a, ids, b"".join, "")
        spaced, newline = Units(a, ids, b"".join, MARK, bare.parts), np.array([v.bytes_at[10]], "<u4").tobytes()
        for batch in batches:
            got = [b"".join(unit_results(spaced_text(t.as_py()), bare, spaced, newline)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, ids binary")


def decode_table(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """The columns of ``rows`` and ``decoded``, the text of its column ``ids``; null ids give null."""

    def run(batches):
        byte = {i: bytes([b]) for b, i in enumerate(v.bytes_at)}
        text = {i: v.pieces[i].replace(MARK, " ").encode() for i in v.plain}
        table = [text.get(i) or byte.get(i, b"") for i in range(len(v.pieces))]
        for batch in batches:
            out = []
            for x in batch.column("ids"):
                ids = x.as_py()
                if ids is not None:
                    t = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
                    ids = t[1:] if t[:1] == " " else t
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, decoded string")


_DIGESTS: dict[str, tuple[Units, Units]] = {}


def _digest_units(v: Vocabulary) -> tuple[Units, Units]:
    """Ids, number of byte ids and text of units, without and with a space before them; kept per worker process."""
    if v.key not in _DIGESTS:
        a, byte = automaton(v), set(v.bytes_at)
        text = dict.fromkeys(range(len(v.pieces)), b"") | {i: v.pieces[i].replace(MARK, " ").encode() for i in v.plain} | {
            i: bytes([b]) for b, i in enumerate(v.bytes_at)}

        def unit(marked):
            ids = a.encode(marked)
            fell = 0 if byte.isdisjoint(ids) else sum(i in byte for i in ids)
            return pack(f"<{len(ids)}I", *ids), fell, b"".join([text[i] for i in ids])

        def join(parts):
            ids, byts, texts = zip(*parts) if parts else ((),) * 3
            return b"".join(ids), sum(byts), b"".join(texts)

        bare = Units(a, unit, join, "")
        _DIGESTS[v.key] = bare, Units(a, unit, join, MARK, bare.parts)
    return _DIGESTS[v.key]


def encode_digest(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Per document: number of ids, of byte ids, CRC-32 of the ids, and whether decoding gives the text back.

    A text that holds the mark itself comes back with a space in its place, as with the model's own library; for it
    ``round_trip`` is false.
    """
    _no_line_end(v)

    def run(batches):
        bare, spaced = _digest_units(v)
        newline = (np.array([v.bytes_at[10]], "<u4").tobytes(), 1, b"\n")
        for batch in batches:
            rows = []
            for t in batch.column(1):
                t = t.as_py() or ""
                crc = n = fell = 0
                back, units = [], unit_results(spaced_text(t), bare, spaced, newline)
                for s in range(0, len(units), 4096):
                    ids, byts, texts = zip(*units[s:s + 4096])
                    joined = b"".join(ids)
                    crc, n, fell = zlib.crc32(joined, crc), n + len(joined) // 4, fell + sum(byts)
                    back.append(b"".join(texts))
                same = b"".join(back)[1:] == t.encode()
                rows.append((n, fell, crc, same))
            n, fell, crc, same = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fell, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")
