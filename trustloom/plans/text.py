"""Text cleaning and text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import text as X
from trustloom.functions.stem import IRREGULAR, STEPS
from trustloom.operators import tokens as K
from trustloom.plans.registry import query
from trustloom.plans.views import r6, round6, with_views

TEXT = "review_text"
STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def lit_sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def remove_sql(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {lit_sql(pattern)}, '{by}', 'g')"


def count_sql(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {lit_sql(pattern)})) AS BIGINT)"


def urls_sql(expr):
    return remove_sql(remove_sql(expr, X.URL), X.WWW)


def phones_sql(expr):
    for p in X.PHONES:
        expr = remove_sql(expr, p)
    return expr


def normalise_sql(expr):
    expr = remove_sql(f"lower({expr})", X.DIGIT + "+")
    return f"trim({remove_sql(remove_sql(expr, X.PUNCTUATION, ' '), X.SPACE_RUN, ' ')})"


def words_sql(expr):
    return f"regexp_extract_all({expr}, {lit_sql(X.WORD_RUN)})"


def keep_sql(tokens):
    return (f"list_filter({tokens}, lambda w: length(w) BETWEEN {X.MIN_WORD} AND {X.MAX_WORD} "
            f"AND NOT w IN ({STOP_SQL}))")


def scrub_sql(expr):
    return phones_sql(remove_sql(urls_sql(remove_sql(expr, X.HTML_TAG)), X.EMAIL))


CLEAN_SQL = f"coalesce(array_to_string({keep_sql(words_sql(normalise_sql(scrub_sql('review_text'))))}, ' '), '')"
CLEANED_CTE = f"cleaned AS (SELECT *, {CLEAN_SQL} AS cleaned_text FROM reviews_v)"


def rows(expr: str, alias: str, source: str = "reviews_v", key: str = "review_id", **views) -> str:
    return with_views(f"SELECT {key}, {expr} AS {alias} FROM {source}", **(views or {"reviews": True}))


@query("strip_html", f"SELECT page_id, {remove_sql('html', X.HTML_TAG)} AS plain FROM pages")
def strip_html(t):
    return t.texts("pages", "page_id").select("page_id", X.strip_html(F.col("html")).alias("plain"))


@query("strip_urls", rows(urls_sql("review_text"), "plain"))
def strip_urls(t):
    return t.reviews().select("review_id", X.strip_urls(TEXT).alias("plain"))


@query("strip_emails", rows(remove_sql("review_text", X.EMAIL), "plain"))
def strip_emails(t):
    return t.reviews().select("review_id", X.strip_emails(TEXT).alias("plain"))


@query("strip_phones", rows(phones_sql("review_text"), "plain"))
def strip_phones(t):
    return t.reviews().select("review_id", X.strip_phones(TEXT).alias("plain"))


@query("normalise_text", rows(normalise_sql("review_text"), "normal"))
def normalise_text(t):
    return t.reviews().select("review_id", X.normalise(TEXT).alias("normal"))


@query("clean_text", rows(CLEAN_SQL, "cleaned_text"))
def clean_text(t):
    return t.reviews().select("review_id", X.clean(TEXT).alias("cleaned_text"))


@query("tokenize", rows(f"CAST(len({words_sql(normalise_sql('review_text'))}) AS BIGINT) AS n_tokens, "
                        f"array_to_string({words_sql(normalise_sql('review_text'))}, '|')", "tokens"))
def tokenize(t):
    toks = X.words(X.normalise(TEXT))
    return t.reviews().select("review_id", F.size(toks).cast("bigint").alias("n_tokens"),
                              F.array_join(toks, "|").alias("tokens"))


@query("filter_tokens", rows(f"array_to_string({keep_sql(words_sql(normalise_sql('review_text')))}, '|')", "tokens"))
def filter_tokens(t):
    return t.reviews().select("review_id", F.array_join(X.keep_tokens(X.words(X.normalise(TEXT))), "|").alias("tokens"))


@query("normalise_tokens", with_views(r"""
SELECT c.review_id, coalesce(string_agg(coalesce(b.base, k.token), ' ' ORDER BY k.pos), '') AS base_text
FROM cleaned c LEFT JOIN toks k USING (review_id) LEFT JOIN bases b USING (token) GROUP BY c.review_id
""", reviews=True, extra=CLEANED_CTE + f""",
lists AS (SELECT review_id, {words_sql('cleaned_text')} AS w FROM cleaned),
toks AS (SELECT review_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM lists),
bases AS (SELECT DISTINCT token, left(token, length(token) - 1) AS base FROM toks
          WHERE length(token) > 3 AND ends_with(token, 's') AND NOT ends_with(token, 'ss'))"""))
def normalise_tokens(t):
    cleaned = t.reviews().select("review_id", X.clean(TEXT).alias("cleaned_text"))
    token = F.col("token")
    bases = (
        cleaned.select(F.explode(X.words(F.col("cleaned_text"))).alias("token"))
        .where((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss")).distinct()
        .select("token", F.expr("left(token, length(token) - 1)").alias("base"))
    )
    return K.apply_base_forms(cleaned, "review_id", "cleaned_text", bases)


def stems_sql():
    """Stems of the table ``words`` (w), one step after the other, as ``stems`` (w, stem)."""
    kinds = ("list_reduce(list_concat([''], string_split(s, '')), lambda k, ch: k || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') OR "
             "(ch = 'y' AND right(k, 1) = 'C') THEN 'V' ELSE 'C' END)")
    ctes = ["st0 AS (SELECT w, w AS s FROM words)"]
    for i, step in enumerate(STEPS, 1):
        ctes.append(f"st{i} AS (SELECT w, {step.format(w='s', cv='cv')} AS s FROM (SELECT w, s, {kinds} AS cv FROM st{i - 1}))")
    known = " ".join(f"WHEN w = '{w}' THEN '{s}'" for w, s in IRREGULAR.items())
    ctes.append(f"stems AS (SELECT w, CASE WHEN length(w) <= 2 THEN w {known} ELSE s END AS stem FROM st{len(STEPS)})")
    return ",\n".join(ctes)


@query("stem_tokens", with_views("""
SELECT c.review_id, coalesce(string_agg(s.stem, ' ' ORDER BY k.pos), '') AS stemmed_text
FROM cleaned c LEFT JOIN toks k USING (review_id) LEFT JOIN stems s ON s.w = k.token GROUP BY c.review_id
""", reviews=True, extra=CLEANED_CTE + f""",
lists AS (SELECT review_id, {words_sql('cleaned_text')} AS l FROM cleaned),
toks AS (SELECT review_id, unnest(l) AS token, unnest(range(1, len(l) + 1)) AS pos FROM lists),
words AS (SELECT DISTINCT token AS w FROM toks), {stems_sql()}"""))
def stem_tokens(t):
    cleaned = t.reviews().select("review_id", X.clean(TEXT).alias("cleaned_text"))
    return K.stemmed_text(cleaned, "cleaned_text", "stemmed_text").select("review_id", "stemmed_text")


@query("text_length", rows("CAST(length(review_text) AS BIGINT)", "text_length"))
def text_length(t):
    return t.reviews().select("review_id", X.text_length(TEXT).cast("bigint").alias("text_length"))


@query("word_count", rows(count_sql("review_text", X.WORD_RUN), "word_count"))
def word_count(t):
    return t.reviews().select("review_id", X.word_count(TEXT).cast("bigint").alias("word_count"))


@query("sentence_count", rows(count_sql("review_text", X.SENTENCE_END) + " + 1", "sentence_count"))
def sentence_count(t):
    return t.reviews().select("review_id", X.sentence_count(TEXT).cast("bigint").alias("sentence_count"))


def avg_word_sql(expr):
    n = count_sql(expr, X.WORD_RUN)
    return f"CASE WHEN {n} > 0 THEN length({remove_sql(expr, X.SPACE_RUN)}) / {n} ELSE 0.0 END"


@query("avg_word_length", rows(r6(avg_word_sql("review_text")), "avg_word_length"))
def avg_word_length(t):
    return t.reviews().select("review_id", round6(X.avg_word_length(TEXT)).alias("avg_word_length"))


@query("cleaned_stats", with_views(
    "SELECT review_id, CAST(length(cleaned_text) AS BIGINT) AS cleaned_text_length, "
    f"{count_sql('cleaned_text', X.WORD_RUN)} AS cleaned_word_count FROM cleaned", reviews=True, extra=CLEANED_CTE))
def cleaned_stats(t):
    cleaned = t.reviews().select("review_id", X.clean(TEXT).alias("c"))
    return cleaned.select("review_id", F.length("c").cast("bigint").alias("cleaned_text_length"),
                          X.word_count(F.col("c")).cast("bigint").alias("cleaned_word_count"))


RATIOS = {"uppercase_ratio": X.UPPER, "digit_ratio": X.DIGIT, "punctuation_ratio": X.PUNCTUATION,
          "special_char_ratio": X.SPECIAL}


def ratio_sql(pattern, expr="review_text"):
    return f"{count_sql(expr, pattern)} / (length({expr}) + 1)"


@query("char_ratios", with_views("SELECT review_id, " + ", ".join(
    f"{r6(ratio_sql(p))} AS {name}" for name, p in RATIOS.items()) + " FROM reviews_v", reviews=True))
def char_ratios(t):
    return t.reviews().select("review_id", *[round6(X.share_of(TEXT, p)).alias(n) for n, p in RATIOS.items()])


def repeated_chars_sql(expr="review_text"):
    return (f"CAST(len(list_filter(list_zip(string_split({expr}, ''), string_split({expr}, '')[2:]), "
            "lambda z: z[1] = z[2])) AS BIGINT)")


@query("repeated_chars", rows(repeated_chars_sql(), "repeated_chars"))
def repeated_chars(t):
    return t.reviews().select("review_id", X.repeated_chars(TEXT).cast("bigint").alias("repeated_chars"))


REPEATED_WORDS_CTE = f"""
rep_tok AS (SELECT review_id, unnest({words_sql('lower(review_text)')}) AS w FROM reviews_v),
rep_cnt AS (SELECT review_id, w, count(*) AS n FROM rep_tok GROUP BY review_id, w),
rep AS (SELECT review_id, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated_words
        FROM rep_cnt GROUP BY review_id)"""


@query("repeated_words", with_views(
    "SELECT v.review_id, coalesce(rep.repeated_words, 0) AS repeated_words FROM reviews_v v LEFT JOIN rep USING "
    "(review_id)", reviews=True, extra=REPEATED_WORDS_CTE.strip()))
def repeated_words(t):
    return t.reviews().select("review_id", X.repeated_words(TEXT).cast("bigint").alias("repeated_words"))


MARKS = {"exclamation_count": "!", "question_count": "?", "comma_count": ",", "period_count": "."}


def mark_sql(mark, expr="review_text"):
    return f"CAST(length({expr}) - length(replace({expr}, '{mark}', '')) AS BIGINT)"


@query("punctuation_counts", with_views("SELECT review_id, " + ", ".join(
    f"{mark_sql(m)} AS {n}" for n, m in MARKS.items()) + " FROM reviews_v", reviews=True))
def punctuation_counts(t):
    return t.reviews().select("review_id",
                              *[X.literal_count(TEXT, m).cast("bigint").alias(n) for n, m in MARKS.items()])


def plain_share_sql(pattern, expr="review_text"):
    return f"CASE WHEN length({expr}) > 0 THEN {count_sql(expr, pattern)} / length({expr}) ELSE 0.0 END"


@query("caps_features", with_views(f"""
SELECT review_id, {r6(plain_share_sql(X.UPPER))} AS capital_ratio,
       CAST(len(list_filter({words_sql('review_text')},
            lambda w: length(w) > 1 AND w = upper(w) AND w <> lower(w))) AS BIGINT) AS all_caps_words
FROM reviews_v""", reviews=True))
def caps_features(t):
    return t.reviews().select("review_id", round6(X.upper_share(TEXT)).alias("capital_ratio"),
                              X.all_caps_words(TEXT).cast("bigint").alias("all_caps_words"))


@query("special_ratio_doc", with_views(f"""
SELECT review_id, {r6(plain_share_sql(X.DIGIT))} AS digit_share,
       {r6(plain_share_sql(X.ASCII_PUNCTUATION))} AS punctuation_share FROM reviews_v""", reviews=True))
def special_ratio_doc(t):
    return t.reviews().select("review_id", round6(X.plain_share(TEXT, X.DIGIT)).alias("digit_share"),
                              round6(X.plain_share(TEXT, X.ASCII_PUNCTUATION)).alias("punctuation_share"))


@query("readability", with_views(f"""
SELECT review_id, {r6('206.835 - 1.015 * (w / s) - 84.6 * (y / w)')} AS reading_ease,
       {r6('0.39 * (w / s) + 11.8 * (y / w) - 15.59')} AS reading_grade
FROM counts""", reviews=True, extra=f"""counts AS (
SELECT review_id, CAST(greatest({count_sql('review_text', X.WORD_RUN)}, 1) AS DOUBLE) AS w,
       CAST(greatest({count_sql('review_text', X.SENTENCE_END)}, 1) AS DOUBLE) AS s,
       CAST({count_sql('lower(review_text)', X.VOWEL_GROUP)} AS DOUBLE) AS y FROM reviews_v)"""))
def readability(t):
    counts = t.reviews().select(
        "review_id", F.greatest(X.word_count(TEXT), F.lit(1)).cast("double").alias("w"),
        F.greatest(X.sentence_count(TEXT) - 1, F.lit(1)).cast("double").alias("s"),
        X.syllables(TEXT).cast("double").alias("y"))
    w, s, y = F.col("w"), F.col("s"), F.col("y")
    return counts.select("review_id", round6(X.reading_ease(w, s, y)).alias("reading_ease"),
                         round6(X.reading_grade(w, s, y)).alias("reading_grade"))


@query("misspelling_count", with_views("""
SELECT v.review_id, CAST(count(k.token) FILTER (WHERE b.token IS NULL) AS BIGINT) AS misspelling_count
FROM reviews_v v LEFT JOIN toks k USING (review_id) LEFT JOIN known b USING (token) GROUP BY v.review_id
""", reviews=True, extra=f"""
toks AS (SELECT review_id, unnest({words_sql(normalise_sql('review_text'))}) AS token FROM reviews_v),
known AS (SELECT DISTINCT unnest({words_sql(normalise_sql('text'))}) AS token FROM benchmark)""".strip()))
def misspelling_count(t):
    known = t.base("benchmark").select(F.explode(X.words(X.normalise(F.col("text")))).alias("token")).distinct()
    return K.unknown_words(t.reviews(), "review_id", X.words(X.normalise(TEXT)), known)


LEXICON_SQL = ", ".join([f"('{w}', 1.0)" for w in X.POSITIVE_WORDS] + [f"('{w}', -1.0)" for w in X.NEGATIVE_WORDS])


@query("lexicon_sentiment", with_views(f"""
SELECT review_id, pos AS positive_hits, neg AS negative_hits,
       {r6('CASE WHEN n > 0 THEN pos / n ELSE 0.0 END')} AS positive,
       {r6('CASE WHEN n > 0 THEN neg / n ELSE 0.0 END')} AS negative,
       {r6('CASE WHEN n > 0 THEN (n - pos - neg) / n ELSE 1.0 END')} AS neutral,
       {r6('s / sqrt(s * s + 15.0)')} AS compound
FROM sums""", reviews=True, extra=f"""
lexicon(token, weight) AS (SELECT col0, CAST(col1 AS DOUBLE) FROM (VALUES {LEXICON_SQL})),
toks AS (SELECT review_id, unnest({words_sql(normalise_sql('review_text'))}) AS token FROM reviews_v),
sums AS (SELECT v.review_id, count(k.token) AS n,
         count(*) FILTER (WHERE x.weight > 0) AS pos, count(*) FILTER (WHERE x.weight < 0) AS neg,
         coalesce(sum(x.weight), 0.0) AS s
         FROM reviews_v v LEFT JOIN toks k USING (review_id) LEFT JOIN lexicon x USING (token)
         GROUP BY v.review_id)""".strip()))
def lexicon_sentiment(t):
    out = K.lexicon_sentiment(t.reviews(), "review_id", X.words(X.normalise(TEXT)), K.default_lexicon(t.spark))
    return out.select("review_id", F.col("positive_hits").cast("bigint"), F.col("negative_hits").cast("bigint"),
                      *[round6(c).alias(c) for c in ("positive", "negative", "neutral", "compound")])


@query("basic_features", with_views(f"""
SELECT review_id, CAST(length(review_text) AS BIGINT) AS text_length,
       {count_sql('review_text', X.WORD_RUN)} AS word_count, {count_sql('review_text', '[.!?]')} AS sentence_marks,
       {r6(ratio_sql(X.ANY_UPPER))} AS uppercase_ratio, {r6(ratio_sql(X.DIGIT))} AS digit_ratio,
       coalesce(rating, 3.0) AS rating FROM reviews_v""", reviews=True))
def basic_features(t):
    return t.reviews().select(
        "review_id", X.text_length(TEXT).cast("bigint").alias("text_length"),
        X.word_count(TEXT).cast("bigint").alias("word_count"),
        F.regexp_count(TEXT, F.lit("[.!?]")).cast("bigint").alias("sentence_marks"),
        round6(X.share_of(TEXT, X.ANY_UPPER)).alias("uppercase_ratio"),
        round6(X.share_of(TEXT, X.DIGIT)).alias("digit_ratio"), F.coalesce("rating", F.lit(3.0)).alias("rating"))
