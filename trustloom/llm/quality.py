"""Quality verdicts by weak supervision: rules vote good, bad or not at all; expectation-maximisation weighs them.

Everything is DataFrame and SQL functions. A document's votes form one of at most 3 ** len(RULES) patterns, so the
estimation runs over counts per pattern: one row with an array, folded ``ROUNDS`` times inside one expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trustloom.llm.common import SPACES, WORDS, document_key, stored, without

ROUNDS = 25
WINDOW = 5
PLAIN = r"[\p{Ll}\p{Lo}\p{Lm}\p{M}\p{N}'’.,;:?\-]+"  # characters that no rule counts

# Rule: (measure, bad if this holds, good if this holds); otherwise the rule abstains. Every measure is a column of `measures`.
RULES = (
    ("length", "n_words < 20", "n_words >= 40"),
    ("word_length", "word_chars > 12.0 * n_words OR word_chars < 2.2 * n_words", "word_chars BETWEEN 3.0 * n_words AND 10.0 * n_words"),
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    ("repeats", "n_repeat_words > 0.15 * n_words", "n_repeat_words <= 0.03 * n_words"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    ("capitals", "n_upper > 0.4 * n_words AND n_upper > 0.2 * word_chars", "n_upper <= 0.1 * word_chars"),
    ("shouting", "n_marks > 0.2 * n_words", "n_marks <= 0.05 * n_words"),
    ("odd_characters", "n_odd > 0.1 * word_chars", "n_odd <= 0.03 * word_chars"),
    ("variety", "n_words >= 40 AND n_distinct < 0.15 * n_words", "n_distinct >= 0.3 * n_words"),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per document: ``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and what the rules read.

    Words are runs of characters other than space and \\t-\\r. Null text has no words. A document's words never leave its
    row: repeated windows are found by sorting their hashes in an array, and only where two hashes of a text are equal.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    df = df.withColumn("w", F.array_remove(F.split("t", WORDS), ""))
    df = df.withColumn("ls", F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    df = df.select(
        "id", F.size("w").cast("long").alias("n_words"), F.array_join("w", "").alias("chars"), "ls",
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    df = df.withColumn("rare", F.regexp_replace("chars", PLAIN, ""))  # capitals and odd characters: one pass over the text

    def count(pattern):
        return (F.length("rare") - F.length(F.regexp_replace("rare", pattern, ""))).cast("long")

    df = df.select(
        "id", "n_words", F.length("chars").cast("long").alias("word_chars"), count(r"[#*$%&|<>]+").alias("n_symbols"),
        count(r"\p{Lu}+").alias("n_upper"), count("!+").alias("n_marks"), count(r"[^\p{Lu}]+").alias("n_odd"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
        F.when(F.size("h") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.size("h") - WINDOW),
            lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).alias("g"))
    df = df.withColumn("g", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.col("g")))
    df = df.withColumn("g", F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("g", F.sort_array(F.transform(
        F.filter("g", lambda x, i: F.coalesce(x["h"] == F.get("g", i - 1)["h"], F.lit(False))
                 | F.coalesce(x["h"] == F.get("g", i + 1)["h"], F.lit(False))), lambda x: x["i"])))
    # windows overlap: each adds the words that the window before it does not hold
    covered = F.aggregate(
        F.transform("g", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(x - F.get("g", i - 1), F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("g")


def vote_columns() -> list:
    """Votes of the rules: 1 good, 0 bad, null where a rule abstains."""
    return [F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END") for _, bad, good in RULES]


# Start of the estimation: share of good documents, and per rule the rates of "good" votes on good documents and of "bad"
# votes on bad ones. They also weigh in as if a share PSEUDO of all documents had shown them, so that a rule for a rare kind
# of rubbish keeps a say where another kind is frequent.
PRIOR, ON_GOOD, ON_BAD = 0.8, 0.98, 0.4
PSEUDO = 0.02


def _fold(n_rules: int, rounds: int) -> str:
    """SQL expression over ``p``, array<struct<v array<int>, n bigint>>: the estimated (prior, on_good, on_bad)."""
    good = ("aggregate(sequence(0, {r}), ln(s.prior), (a, j) -> a + CASE x.v[j] WHEN 1 THEN ln(s.good[j]) "
            "WHEN 0 THEN ln(1 - s.good[j]) ELSE 0D END)")
    bad = ("aggregate(sequence(0, {r}), ln(1 - s.prior), (a, j) -> a + CASE x.v[j] WHEN 0 THEN ln(s.bad[j]) "
           "WHEN 1 THEN ln(1 - s.bad[j]) ELSE 0D END)")
    posts = (f"transform(p, x -> named_struct('v', x.v, 'n', CAST(x.n AS double), 'q', "
             f"1 / (1 + exp({bad} - {good}))))")
    # sums over the patterns: documents, weight of good, and per rule votes on good and bad weight
    share = "(aggregate(q, 0D, (a, x) -> a + x.n * x.q) + {c} * {prior}) / (aggregate(q, 0D, (a, x) -> a + x.n) + {c})"
    rate = ("transform(sequence(0, {r}), j -> (aggregate(q, 0D, (a, x) -> a + CASE WHEN x.v[j] = {hit} THEN x.n * {w} ELSE 0D END)"
            " + {c} * {start}) / (aggregate(q, 0D, (a, x) -> a + CASE WHEN x.v[j] IS NOT NULL THEN x.n * {w} ELSE 0D END) + {c}))")
    new = (f"named_struct('prior', {share}, 'good', {rate.replace('{hit}', '1').replace('{w}', 'x.q').replace('{start}', '{g0}')}, "
           f"'bad', {rate.replace('{hit}', '0').replace('{w}', '(1 - x.q)').replace('{start}', '{b0}')})")
    start = "named_struct('prior', {prior}, 'good', transform(sequence(0, {r}), j -> {g0}), 'bad', transform(sequence(0, {r}), j -> {b0}))"
    out = f"aggregate(sequence(1, {rounds}), {start}, (s, k) -> transform(array({posts}), q -> {new})[0])"
    for name, value in (("r", n_rules - 1), ("prior", f"{PRIOR}D"), ("g0", f"{ON_GOOD}D"), ("b0", f"{ON_BAD}D"), ("c", "coalesce(c, 1D)")):
        out = out.replace("{" + name + "}", str(value))
    return out


def estimate(votes: DataFrame, n_rules: int, rounds: int = ROUNDS) -> dict:
    """Prior and rates from the column ``v`` (array of votes). Without rows these are the starting values."""
    patterns = votes.groupBy("v").agg(F.count("*").alias("n"))
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"), (F.sum("n") * PSEUDO).alias("c")).select(  # at most 3 ** n_rules patterns
        F.expr(_fold(n_rules, rounds)).alias("s")).first()["s"]
    return {"prior": row["prior"], "good": list(row["good"]), "bad": list(row["bad"])}


def posterior(rates: dict):
    """Probability that a document is good, given its votes ``v``."""
    from math import log

    odds = F.lit(log(rates["prior"]) - log(1 - rates["prior"]))
    for j, (g, b) in enumerate(zip(rates["good"], rates["bad"])):
        vote = F.get("v", F.lit(j))
        odds = odds + F.when(vote == 1, log(g) - log(1 - b)).when(vote == 0, log(1 - g) - log(b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 10,
             repeat_percent: int = 20, threshold: float = 0.5) -> DataFrame:
    """``id``, the counts, ``base_failed``, ``p_good`` and ``kept`` of every row.

    ``base_failed``: fewer than ``min_words`` words, or more than ``repeat_percent`` % of the words in repeated windows. Such
    rows are not kept and do not take part in the estimation; others are kept if ``p_good`` reaches ``threshold``. Null text
    has no words. An empty table gives no rows; ids may be null or repeat.
    """
    rows = measures(docs, id_col, text_col).withColumn(
        "base_failed", F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {repeat_percent} * n_words"))
    rows = stored(rows.withColumn("v", F.array(*vote_columns())), "votes")
    rates = estimate(rows.where("NOT base_failed"), len(RULES))
    return rows.withColumn("p_good", posterior(rates)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop("v")


def without_rejects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose document is kept.

    Rows find their verdict by id and content hash, so null ids and different texts with one id are told apart; rows that repeat
    both are one document. Null text has no words and goes. An empty table gives no rows.
    """
    keyed = docs.select(document_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    away = stored(verdicts(keyed, "key", "text").where("NOT kept").select(F.col("id").alias("key")).distinct(), "away")
    return without(docs, away, id_col, text_col)
