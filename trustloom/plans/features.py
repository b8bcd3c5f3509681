"""Feature frames, text vectors and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import text as X
from trustloom.operators import behaviour as B, cooccurrence as O, features as FE, similarity as S, vectors as V
from trustloom.plans.aggregates import rounded
from trustloom.plans.joins import stats_sql
from trustloom.plans.registry import query
from trustloom.plans.text import CLEANED_CTE, REPEATED_WORDS_CTE, STOP_SQL, avg_word_sql, count_sql, lit_sql, mark_sql, \
    ratio_sql, repeated_chars_sql
from trustloom.plans.views import r6, round6, with_views
from trustloom.plans.windows import ANOMALY_SQL, GAPS_SQL
from trustloom.session import written

C = F.col

TERMS_SQL = f"""list_filter(regexp_extract_all(translate(lower(review_text), '{X.ACCENTED}', '{X.UNACCENTED}'),
 {lit_sql(f'[{X.WORD_CHARS}]+')}), lambda w: regexp_full_match(w, '[a-z]{{2,}}') AND NOT w IN ({STOP_SQL}))"""


def grams_sql(longest):
    def runs(n):
        shifted = ", ".join(f"w[{i + 1}:greatest(len(w) - {n - 1 - i}, 0)]" for i in range(n))
        return f"list_transform(list_zip({shifted}), lambda z: concat_ws(' ', {', '.join(f'z[{i + 1}]' for i in range(n))}))"

    parts = ["w", *map(runs, range(2, longest + 1))]
    return f"""docs AS (SELECT review_id, {TERMS_SQL} AS w FROM reviews_v),
grams AS (SELECT review_id, unnest(list_concat({', '.join(parts)})) AS term FROM docs)"""


def grams(t, longest):
    docs = t.reviews().select("review_id", X.terms(C("review_text")).alias("w"))
    return V.with_ngrams(docs, "w", "terms", longest).select("review_id", "terms")


@query("ngrams", with_views("SELECT review_id, count(*) AS n, count(DISTINCT term) AS distinct_terms, min(term) AS first_term, "
                            "max(term) AS last_term FROM grams GROUP BY review_id", reviews=True, extra=grams_sql(3)))
def ngrams(t):
    rows = grams(t, 3).select("review_id", F.size("terms").cast("bigint").alias("n"),
                              F.size(F.array_distinct("terms")).cast("bigint").alias("distinct_terms"),
                              F.array_min("terms").alias("first_term"), F.array_max("terms").alias("last_term"))
    return rows.where("n > 0")


VOCAB_SQL = """tf AS (SELECT review_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM reviews_v),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term HAVING count(*) >= 2 AND
 count(*) <= 0.95 * (SELECT n FROM n) ORDER BY total DESC, term LIMIT 5000)"""


@query("vocab_topk", with_views("SELECT term, df, total FROM vocab", reviews=True, extra=f"{grams_sql(3)}, {VOCAB_SQL}"))
def vocab_topk(t):
    docs = grams(t, 3)
    return V.frequent_terms(docs, "terms", docs.count())


@query("tfidf", with_views(f"SELECT review_id, term, {r6('x / norm')} AS weight FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY "
                           "review_id)) AS norm FROM raw)", reviews=True, extra=f"""{grams_sql(1)}, {VOCAB_SQL},
raw AS (SELECT review_id, term, tf * (ln((1.0 + (SELECT n FROM n)) / (1 + df)) + 1) AS x FROM tf JOIN vocab USING (term))"""))
def tfidf(t):
    docs = grams(t, 1)
    n = docs.count()
    vocab = V.frequent_terms(docs, "terms", n)
    counts = V.kept_counts(docs, "review_id", "terms", vocab.select("term"))
    return rounded(V.tfidf(counts, vocab, n, "review_id"), ("weight",))


@query("word_information", with_views(f"""
SELECT a AS word, count(*) AS neighbours, {r6('max(ln(n * total / (na * nb)))')} AS strongest
FROM pairs JOIN (SELECT a, sum(n) AS na FROM pairs GROUP BY 1) USING (a) JOIN (SELECT a AS b, sum(n) AS nb FROM pairs GROUP BY 1) USING (b),
 (SELECT CAST(sum(n) AS DOUBLE) AS total FROM pairs) WHERE ln(n * total / (na * nb)) > 0 GROUP BY 1""", reviews=True, extra=f"""
docs AS (SELECT {TERMS_SQL} AS w FROM reviews_v),
near AS ({" UNION ALL ".join(f"SELECT unnest(w[:greatest(len(w) - {d}, 0)]) AS x, unnest(w[{d + 1}:]) AS y, {3 - d} AS n FROM docs" for d in (1, 2))}),
pairs AS (SELECT a, b, sum(n) AS n FROM (SELECT x AS a, y AS b, n FROM near UNION ALL SELECT y, x, n FROM near) GROUP BY 1, 2)""".strip()))
def word_information(t):
    docs = t.reviews().select(X.terms(C("review_text")).alias("w"))
    values = O.ordered_information(written(O.ordered_pairs(docs, "w", 2), "word-pairs"))
    out = values.groupBy(C("a").alias("word")).agg(F.count("*").alias("neighbours"), F.max("value").alias("strongest"))
    return rounded(out, ("strongest",))


def stat_join_sql(key, prefix):
    names = {"rating_count": "rating_count", "rating_mean": r6("{}.rating_mean"), "rating_std": r6("{}.rating_std"),
             "length_mean": r6("{}.length_mean"), "length_std": r6("{}.length_std")}
    return ", ".join(f"{(e.format(prefix) if '{' in e else prefix + '.' + e)} AS {prefix}_{n}" for n, e in names.items())


@query("preprocess", with_views(f"""
SELECT f.review_id, md5(c.cleaned_text) AS cleaned_md5, f.kind IS NOT NULL AS temporal_anomaly,
 CAST(length(f.review_text) AS BIGINT) AS text_length, {count_sql('f.review_text', X.WORD_RUN)} AS text_word_count,
 {count_sql('f.review_text', X.SENTENCE_END)} + 1 AS text_sentence_count, {r6(avg_word_sql('f.review_text'))} AS text_avg_word_length,
 CAST(length(c.cleaned_text) AS BIGINT) AS cleaned_text_length, {count_sql('c.cleaned_text', X.WORD_RUN)} AS cleaned_word_count,
 {', '.join(f"{r6(ratio_sql(p, 'f.review_text'))} AS text_{n}" for n, p in FE.TEXT_RATIOS.items())},
 {repeated_chars_sql('f.review_text')} AS text_repeated_chars, coalesce(rep.repeated_words, 0) AS text_repeated_words,
 CAST(CASE WHEN f.rating IN (1, 5) THEN 1 ELSE 0 END AS BIGINT) AS rating_is_extreme, f.rating AS rating_numerical,
 hour(f.date) AS review_hour, isodow(f.date) - 1 AS review_day_of_week, month(f.date) AS review_month,
 CAST(CASE WHEN isodow(f.date) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS review_is_weekend,
 {stat_join_sql('user_id', 'usr')}, {stat_join_sql('product_id', 'product')}
FROM flagged f JOIN cleaned c USING (review_id) LEFT JOIN rep ON rep.review_id = f.review_id
LEFT JOIN usr ON usr.user_id = f.user_id LEFT JOIN product ON product.product_id = f.product_id""", reviews=True,
                                extra=f"""{CLEANED_CTE}, {GAPS_SQL}, {ANOMALY_SQL}, {REPEATED_WORDS_CTE},
usr AS ({stats_sql('user_id')}), product AS ({stats_sql('product_id')})"""))
def preprocess(t):
    out = FE.preprocess(t.reviews(), t.now())
    counts = ["text_length", "text_word_count", "text_sentence_count", "cleaned_text_length", "cleaned_word_count",
              "text_repeated_chars", "text_repeated_words", "rating_is_extreme"]
    doubles = ["text_avg_word_length", *[f"text_{n}" for n in FE.TEXT_RATIOS]]
    stats = ["rating_mean", "rating_std", "length_mean", "length_std"]
    return out.select(
        "review_id", F.md5("review_text_cleaned").alias("cleaned_md5"), "temporal_anomaly",
        *[C(c).cast("bigint").alias(c) for c in counts], *[round6(c).alias(c) for c in doubles], "rating_numerical",
        "review_hour", "review_day_of_week", "review_month", "review_is_weekend",
        *[C(f"{p}_rating_count").alias(f"{q}_rating_count") for p, q in (("user", "usr"), ("product", "product"))],
        *[round6(f"{p}_{s}").alias(f"{q}_{s}") for p, q in (("user", "usr"), ("product", "product")) for s in stats])


@query("review_behaviour", with_views(f"""
SELECT v.review_id, CAST(length(review_text) AS BIGINT) AS review_length, {count_sql('review_text', X.WORD_RUN)} AS word_count,
 {r6(avg_word_sql('review_text'))} AS avg_word_length, {r6(ratio_sql(X.UPPER))} AS uppercase_ratio,
 {r6(ratio_sql(X.PUNCTUATION))} AS punctuation_ratio, {mark_sql('!')} AS exclamation_count, {mark_sql('?')} AS question_count,
 u.n AS user_text_count, {r6('u.m')} AS user_rating_mean, {r6('coalesce(u.s, 0)')} AS user_rating_std, u.d AS user_dates,
 p.n AS product_text_count, {r6('p.m')} AS product_rating_mean, {r6('coalesce(p.s, 0)')} AS product_rating_std,
 p.d AS product_reviewers, hour(v.date) AS review_hour, v.rating AS rating_value
FROM reviews_v v JOIN u USING (user_id) JOIN p USING (product_id)""", reviews=True, extra="""
u AS (SELECT user_id, count(*) AS n, avg(rating) AS m, stddev_samp(rating) AS s, count(DISTINCT date) AS d FROM reviews_v GROUP
 BY 1), p AS (SELECT product_id, count(*) AS n, avg(rating) AS m, stddev_samp(rating) AS s, count(DISTINCT user_id) AS d FROM
 reviews_v GROUP BY 1)""".strip()))
def review_behaviour(t):
    out = FE.review_behaviour(t.reviews())
    ints = ["review_length", "word_count", "exclamation_count", "question_count"]
    doubles = ["avg_word_length", "uppercase_ratio", "punctuation_ratio", "user_rating_mean", "user_rating_std",
               "product_rating_mean", "product_rating_std"]
    return out.select("review_id", *[C(c).cast("bigint").alias(c) for c in ints], *[round6(c).alias(c) for c in doubles],
                      "user_text_count", "user_dates", "product_text_count", "product_reviewers", "review_hour", "rating_value")


USER_VECTOR = ("rating", "n", "hour", "minute")


def user_vectors(t):
    mean = t.events().groupBy("user_id").agg(
        F.avg("value").alias("value"), F.count("*").cast("double").alias("n"), F.avg(F.hour("ts")).alias("hour"),
        F.avg((C("event_id") % 5).cast("double")).alias("rating"))
    return FE.scale(mean, ["value", "n", "hour", "rating"], "standard").select(
        "user_id", F.array("value", "n", "hour", "rating").alias("v"))


USER_VECTOR_SQL = """m AS (SELECT user_id, avg(value) AS value, CAST(count(*) AS DOUBLE) AS n, avg(hour(ts)) AS hour,
 avg(CAST(event_id % 5 AS DOUBLE)) AS rating FROM events GROUP BY user_id),
s AS (SELECT user_id, [(value - avg(value) OVER ()) / stddev_pop(value) OVER (), (n - avg(n) OVER ()) / stddev_pop(n) OVER (),
 (hour - avg(hour) OVER ()) / stddev_pop(hour) OVER (), (rating - avg(rating) OVER ()) / stddev_pop(rating) OVER ()] AS v FROM m)"""


@query("user_similarity", f"""WITH {USER_VECTOR_SQL}
SELECT a.user_id, {r6('max(list_cosine_similarity(a.v, b.v))')} AS max_similarity,
 {r6('avg(list_cosine_similarity(a.v, b.v))')} AS avg_similarity,
 count(*) FILTER (WHERE list_cosine_similarity(a.v, b.v) > 0.8) AS similar_users_count
FROM s a JOIN s b ON a.user_id <> b.user_id GROUP BY a.user_id""")
def user_similarity(t):
    out = S.dense_similarity(user_vectors(t), "user_id", "v", [0.8])
    return rounded(out, ("max_similarity", "avg_similarity")).withColumnRenamed("over0", "similar_users_count")


@query("embedding_similarity", f"""
SELECT a.vec_id, {r6('max(list_cosine_similarity(a.v, b.v))')} AS max_similarity,
 {r6('avg(list_cosine_similarity(a.v, b.v))')} AS avg_similarity,
 count(*) FILTER (WHERE list_cosine_similarity(a.v, b.v) > 0.5) AS similar_count
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b
 ON a.vec_id <> b.vec_id GROUP BY a.vec_id""")
def embedding_similarity(t):
    out = S.dense_similarity(t.base("embeddings"), "vec_id", "embedding", [0.5])
    return rounded(out, ("max_similarity", "avg_similarity")).withColumnRenamed("over0", "similar_count")


PLAIN_SQL = f"""docs AS (SELECT review_id, unnest(list_filter(regexp_extract_all(lower(review_text),
 {lit_sql(f'[{X.WORD_CHARS}]+')}), lambda w: length(w) >= 2 AND NOT w IN ({STOP_SQL}))) AS term FROM reviews_v),
tf AS (SELECT review_id, term, count(*) AS tf FROM docs GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM reviews_v),
vocab AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000),
raw AS (SELECT review_id, term, tf * (ln((1.0 + (SELECT n FROM n)) / (1 + df)) + 1) AS x FROM tf JOIN vocab USING (term)),
w AS (SELECT review_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY review_id)) AS x FROM raw),
sims AS (SELECT a.review_id, b.review_id AS other, sum(a.x * b.x) AS sim FROM w a JOIN w b ON a.term = b.term AND
 a.review_id <> b.review_id GROUP BY 1, 2)"""


@query("review_similarity", with_views(f"""
SELECT v.review_id, {r6('coalesce(max(sim), 0)')} AS max_text_similarity,
 {r6('coalesce(sum(sim), 0) / ((SELECT n FROM n) - 1)')} AS avg_text_similarity,
 count(*) FILTER (WHERE sim > 0.7) AS similar_reviews_count, count(*) FILTER (WHERE sim > 0.9) AS highly_similar_reviews
FROM reviews_v v LEFT JOIN sims USING (review_id) GROUP BY v.review_id""", reviews=True, extra=PLAIN_SQL))
def review_similarity(t):
    docs = t.reviews().select("review_id", V.word_terms(C("review_text")).alias("terms"))
    out = rounded(S.text_similarity(docs, "review_id", "terms"), ("max_text_similarity", "avg_text_similarity"))
    return out.withColumnsRenamed({"over0": "similar_reviews_count", "over1": "highly_similar_reviews"})


@query("jaccard_users", with_views(f"""
SELECT a.user_id, coalesce(s.c, 0) AS similar_users, {r6('coalesce(s.m, 0)')} AS max_jaccard FROM d a LEFT JOIN (
 SELECT x.user_id, count(*) AS c, max(i / (x.n + y.n - i)) AS m FROM (SELECT e.user_id, f.user_id AS other, count(*) AS i FROM e
  JOIN e f ON e.product_id = f.product_id AND e.user_id <> f.user_id GROUP BY 1, 2) p JOIN d x ON x.user_id = p.user_id JOIN d y
  ON y.user_id = p.other WHERE i / (x.n + y.n - i) >= 0.5 GROUP BY x.user_id) s USING (user_id)""", reviews=True, extra="""
e AS (SELECT DISTINCT user_id, product_id FROM reviews_v), d AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1)""".strip()))
def jaccard_users(t):
    return rounded(S.jaccard_users(t.reviews(), "user_id", "product_id", 0.5), ("max_jaccard",))


@query("knn_minority", """
WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 3),
d AS (SELECT a.vec_id, b.vec_id AS neighbor, list_distance(a.v, b.v) AS distance, CAST(row_number() OVER (PARTITION BY a.vec_id
 ORDER BY list_distance(a.v, b.v), b.vec_id) AS BIGINT) AS position FROM m a JOIN m b ON a.vec_id <> b.vec_id)
SELECT vec_id, neighbor, position, floor(distance * 1e6 + 0.5) / 1e6 AS distance FROM d WHERE position <= 5""")
def knn_minority(t):
    minority = t.base("embeddings").where("label = 3")
    out = rounded(S.nearest(minority, "vec_id", "embedding", 5), ("distance",))
    return out.withColumn("position", C("position").cast("bigint"))
