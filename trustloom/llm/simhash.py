"""SimHash fingerprints of word shingles, and near-duplicate groups over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trustloom.llm.common import document_key, dropped, stored, without, word_blocks
from trustloom.llm.components import components
from trustloom.llm.hamming import links

SEED = 42


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64; no words: 0; fewer words than a shingle: one shingle."""
    import xxhash

    ones, total, tail = np.zeros(64, np.int64), 0, []
    for block in word_blocks((text or b"").lower()):
        words = tail + block
        made = zip(*[words[i:] for i in range(shingle)])
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, made)]
        tail = words[max(0, len(words) - shingle + 1):]
        if hashes:
            ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                axis=0, dtype=np.int64)
            total += len(hashes)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3) -> DataFrame:
    """``id, fp`` of every row: fp is the fingerprint's bit pattern as bigint; a null text has no words, so 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            got = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, fp long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3) -> DataFrame:
    """``id, fp, component_id`` of every row: fingerprints link at two or fewer differing bits.

    Words: runs of bytes other than space and \\t-\\r, after lower-casing A-Z. Null and empty texts have fingerprint 0 and
    are linked like any other. ``component_id`` is the smallest id of the component; null ids are skipped (null only if
    the component has no other id). Rows that repeat come out as often as they come in. Equal fingerprints are one node
    of the search, so copies cost nothing there.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle=shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    found = links(nodes)
    roots = components(found)
    group = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    group = stored(group, "groups")
    lows = group.groupBy("root").agg(F.min("low").alias("component_id"))
    group = stored(group.join(lows, "root").select("fp", "component_id"), "lows")
    dropped(nodes, found)
    return rows.join(group, "fp").select("id", "fp", "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group in :func:`near_groups`: one document of each group.

    The document with the smallest id stays (an id is smaller than null; equal ids: the smaller SHA-256 of the text). Rows
    find their decision by id and content hash, so null ids and different texts with one id are told apart; rows that repeat
    both are one document. Null text counts as empty. An empty table gives no rows; other columns may have any names.
    """
    key = document_key(id_col, text_col)
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), key["id"].alias("id"), key["sha"].alias("sha")).alias("id"),
                        F.col(text_col).alias("text"))
    groups = near_groups(keyed, "id", "text", shingle=shingle)
    away = groups.where("id <> component_id").select(F.struct("id.id", "id.sha").alias("key")).distinct()
    return without(docs, stored(away, "away"), id_col, text_col)
