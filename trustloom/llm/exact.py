"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first pass counts rows per (length, hash of the first ``prefix`` characters): both come from the same read of the text
column, and a group of one is settled there. Only rows of surviving groups get their whole content hashed (SHA-256) in the
second pass; no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trustloom.llm.common import BROADCAST_ROWS, dropped, small, stored, unused

PREFIX = 256


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix: int = PREFIX,
                carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept`` and the ``carry`` columns (expressions over ``docs``).

    Null text counts as empty. Of equal texts the row with the largest id stays (a null id is smaller than any other); of
    repeated rows with that id exactly one stays. An empty table gives an empty result. Other columns of ``docs`` are not
    looked at, whatever their names.
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, head = F.octet_length(text).cast("long"), F.xxhash64(F.substring(text, 1, prefix))
    groups = stored(docs.select(size.alias("size"), head.alias("head")).groupBy("size", "head").agg(F.count("*").alias("n"))
                    .where("n > 1").select("size", "head", F.lit(True).alias("again")), "copies")
    rows = groups.count()
    scan = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), size.alias("size"),
                       head.alias("head"), text.alias("body"), *[c.alias(f"carry_{k}") for k, c in carry.items()])
    extra = [f"carry_{k}" for k in carry]
    if rows <= BROADCAST_ROWS:
        scan = scan.join(F.broadcast(groups), ["size", "head"], "left")
        full = F.when(F.col("again"), F.sha2("body", 256))
        marked = scan.select("rid", "id", "size", full.alias("full"), *extra)
    else:  # too many keys to broadcast: hash before the join, so that the shuffle carries hashes and not texts
        scan = scan.select("rid", "id", "size", "head", F.sha2("body", 256).alias("full"), *extra)
        marked = scan.join(groups, ["size", "head"], "left").select(
            "rid", "id", "size", F.when(F.col("again"), F.col("full")).alias("full"), *extra)
    marked = stored(marked, "marked")
    equal = stored(marked.where("full IS NOT NULL").groupBy("size", "full")
                   .agg(F.max(F.struct("id", "rid")).alias("keep"), F.count("*").alias("n")).where("n > 1"), "equal")
    found = small(equal, equal.count())
    out = marked.join(found, ["size", "full"], "left").select(
        "id", F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        *[F.col(f"carry_{k}").alias(k) for k in carry])
    dropped(groups)
    return out


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that :func:`copy_groups` keeps.

    Rows find their decision by id and content hash; rows that repeat both are one document and one of them stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    decided = stored(copy_groups(docs, id_col, text_col, carry={"sha": F.sha2(text, 256)}), "decided")
    lost = decided.where("NOT kept").count()
    if not lost:
        return docs
    name = unused(docs, "kept")
    kept = decided.where("kept").select(F.col("id").alias(f"{name}_id"), F.col("sha").alias(f"{name}_sha"))
    repeats = decided.groupBy("id", "sha").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    marked = docs.withColumn(name, F.sha2(text, 256))
    out = marked.join(kept, marked[id_col].eqNullSafe(kept[f"{name}_id"]) & (marked[name] == kept[f"{name}_sha"]), "left_semi")
    return (out.dropDuplicates([id_col, name]) if repeats else out).drop(name)
