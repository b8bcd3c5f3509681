"""Quality classifier: bits per character under a Kneser-Ney model of trusted text, and thresholds per language.

``classify`` uses the model over whole characters (``characters``), whose tables stay in Spark. The functions ``grams``, ``counts``,
``probabilities`` and ``scores`` here are a smaller model over classes of characters (``CLASSES`` of them, given by a rule, order
``ORDER``), for callers that want a table of fixed size; no query uses it.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trustloom.llm import characters
from trustloom.llm.characters import discounts
from trustloom.llm.common import document_key, dropped, small, stored, without

ORDER, EDGE = 4, 0
BLOCK = 1 << 20
# Characters with a class of their own, and groups of characters that share one.
SINGLE = ["\n", *"abcdefghijklmnopqrstuvwxyz", ".", ","]
GROUPS = ["'’-", ";:!?", "\"()[]{}«»“”„", "#*$%&|<>=+~^@/\\_`"]
SPACE, CAPITAL, DIGIT, GROUP = 1 + len(SINGLE), 2 + len(SINGLE), 3 + len(SINGLE), 4 + len(SINGLE)
SMALL = GROUP + len(GROUPS)  # other small letters: eight classes by code point
LETTER, REST = SMALL + 8, SMALL + 9
CLASSES = REST + 1


def _class(c: str) -> int:
    if c in SINGLE:
        return 1 + SINGLE.index(c)
    for k, group in enumerate(GROUPS):
        if c in group:
            return GROUP + k
    kind = unicodedata.category(c)
    if c.isspace():
        return SPACE
    return {"Lu": CAPITAL, "Lt": CAPITAL, "Nd": DIGIT, "Ll": SMALL + ord(c) % 8, "Lo": LETTER, "Lm": LETTER, "Mn": LETTER,
            "Mc": LETTER}.get(kind, REST)


@cache
def _table() -> np.ndarray:
    return np.array([_class(chr(i)) for i in range(0x10000)] + [REST], np.int64)


def grams(text: str | None):
    """Codes of the n-grams of a text in blocks, the last one ending in the edge class: one n-gram per character, and one more."""
    text, before = text or "", np.full(ORDER - 1, EDGE, np.int64)
    for start in range(0, max(1, len(text)), BLOCK):
        part = text[start:start + BLOCK]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = np.concatenate([before, _table()[np.minimum(points, 0x10000)],
                                  [EDGE] if start + BLOCK >= len(text) else []]).astype(np.int64)
        n = len(classes) - ORDER + 1
        code = np.zeros(n, np.int64)
        for k in range(ORDER):
            code = code * CLASSES + classes[k:k + n]
        before = classes[n:]
        yield code


def counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram, n``: how often each n-gram of the highest order occurs in the texts; at most CLASSES ** ORDER rows."""

    def run(batches):
        total, held, waiting = np.zeros(CLASSES ** ORDER, np.int64), [], 0
        codes = (code for batch in batches for t in batch.column(0) for code in grams(t.as_py()))
        for code in codes:
            held.append(code)
            waiting += len(code)
            if waiting >= BLOCK:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        seen = np.flatnonzero(total)
        for s in range(0, len(seen), 100_000):
            at = seen[s:s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["gram", "n"])

    return texts.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def probabilities(gram_counts: DataFrame) -> np.ndarray:
    """Probability of the last class of each n-gram given the ones before, for all CLASSES ** ORDER n-grams.

    Highest order: plain counts; below: in how many contexts an n-gram occurs. Without counts all classes are equally
    probable.
    """
    p = np.full(CLASSES, 1 / CLASSES)
    tables = [stored(gram_counts, "grams")]
    for order in range(ORDER - 1, 0, -1):  # different left extensions of the n-grams one order up
        tables.append(stored(tables[-1].groupBy((F.col("gram") % CLASSES ** order).alias("gram")).agg(
            F.count("*").alias("n")), "grams"))
    for order, table in zip(range(1, ORDER + 1), reversed(tables)):
        d = discounts(*table.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first())
        shard = table.select(F.floor(F.col("gram") / CLASSES).alias("context"), "gram", "n",
                             F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]).alias("d"))
        context = shard.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
        rows = shard.join(context, "context").select(
            "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"),
            (F.col("taken") / F.col("total")).alias("back")).toArrow()  # at most CLASSES ** order rows
        at, seen, left = (rows.column(i).to_numpy() for i in range(3))
        own, back = np.zeros(CLASSES ** order), np.ones(CLASSES ** (order - 1))
        own[at] = seen
        back[at // CLASSES] = left
        lower = np.tile(p.reshape(-1, CLASSES), (CLASSES if order > 1 else 1, 1))
        p = (own.reshape(-1, CLASSES) + back[:, None] * lower).ravel()
    dropped(*tables)
    return p


def scores(docs: DataFrame, p: np.ndarray, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, lang, n_events, bits`` of every row: bits per character (base-2 logarithm of the perplexity) on a grid of 1/1000.

    Every text also has the event of its end, so an empty or null text has a score too.
    """
    cost = docs.sparkSession.sparkContext.broadcast(-np.log2(p).astype(np.float32))  # CLASSES ** ORDER values

    def run(batches):
        table = cost.value
        for batch in batches:
            n, bits = [], []
            for t in batch.column(2):
                k, b = 0, 0.0
                for code in grams(t.as_py()):
                    k, b = k + len(code), b + float(table[code].sum(dtype=np.float64))
                n.append(k)
                bits.append(round(b / k, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(bits, pa.float64())],
                                             ["id", "lang", "n_events", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body")
                       ).mapInArrow(run, f"id {kind}, lang string, n_events long, bits double")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of documents labelled as good and not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col(id_col).alias("_trusted")).where(
        "_trusted IS NOT NULL").distinct()


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
             quantile: float = 0.99, slack: float = 1.0, key: Column | None = None) -> DataFrame:
    """``id, lang, n_events, bits, perplexity, limit, kept`` of every row of ``docs``.

    ``trusted`` (one column ``_trusted``, different ids) names the documents the model learns from. A document is kept if its
    bits per character are at most the limit of its language: the ``quantile`` of the trusted documents of that language (the
    smallest score that so large a share does not exceed), times ``slack``. A trusted document is scored by the model of the
    half of the trusted ones that it is not in, so that the limit holds for documents the model has not seen. Languages
    without trusted documents, and null, take the quantile of all trusted documents; without any all documents are kept. An
    empty table gives no rows; ids may be null or repeat. ``key`` (an expression over ``docs``) stands for the id in the result.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                       (F.col(id_col) if key is None else key).alias("key"))
    n = trusted.count()
    half = F.when(F.col("_trusted").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    marked = docs.join(small(trusted, n // 10), F.col("id") == F.col("_trusted"), "left")  # 8 bytes a row: 10 x the usual rows
    rows = characters.scores(marked.select(F.col("key").alias("id"), F.col("lang").cast("string").alias("lang"),
                                           F.col("text").alias("body"), half.alias("half")))
    good, cut = rows.where("good"), F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY bits)") * slack
    limits = stored(good.where("lang IS NOT NULL").groupBy("lang").agg(cut.alias("own")), "limits")  # on the grid of the scores, so of bounded size
    every = good.agg(cut.alias("x")).first()["x"]
    every = F.lit(None).cast("double") if every is None else F.lit(every)
    return rows.join(small(limits, limits.count()), "lang", "left").select(
        "id", "lang", "n_events", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.coalesce("own", every).alias("limit")
    ).withColumn("kept", F.coalesce(F.col("bits") <= F.col("limit"), F.lit(True)))


def without_rejects(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose document is kept.

    Rows find their decision by id and content hash, so null ids and different texts with one id are told apart; rows that repeat
    both are one document. Null text counts as empty. An empty table gives no rows.
    """
    rows = classify(docs, trusted, id_col, text_col, lang_col, key=document_key(id_col, text_col))
    away = stored(rows.where("NOT kept").select(F.col("id").alias("key")).distinct(), "away")
    return without(docs, away, id_col, text_col)
