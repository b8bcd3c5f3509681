"""The operators over their whole tables, under the names of the driver, with SQL twins where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustloom.llm import chat, divergence, exact, html, kneser, merkle, packing, pieces, pitman_yor, quality, simhash, tokens, topk
from trustloom.llm.divergence_sql import divergence_sql
from trustloom.llm.merkle_sql import manifest_sql
from trustloom.llm.quality_sql import quality_sql
from trustloom.session import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact.copy_groups(docs, carry={"text_sha256": digest}).withColumnRenamed("id", "doc_id")


def _file(name: str) -> str:
    """Place of a public tokenizer's file on the driver; tasks get its content, not its place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = pieces.read_vocabulary(_file("piece_bpe_32k.model"))
    return tokens.token_counts(_table(spark, sf_dir, "documents"), vocab).withColumnRenamed("id", "doc_id")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids; of the ids themselves only the checksum is kept."""
    with open(_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        cut = packing.token_pieces(docs, f.read(), checksums=True)
    return packing.pack(cut.withColumnRenamed("id", "doc_id"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdicts(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", (F.floor(F.col("p_good") * 1e6 + 0.5) / 1e6).alias("p_good"))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    rows = chat.preferences(turns, chat.neighbour_pairs(turns))
    return rows.withColumns({"chosen_mask": chat.mask_text("chosen_mask"), "rejected_mask": chat.mask_text("rejected_mask")})


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(_table(spark, sf_dir, "documents"), pieces.read_vocabulary(_file("piece_bpe_32k.model")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = kneser.trusted_ids(_table(spark, sf_dir, "labels"))
    return kneser.classify(_table(spark, sf_dir, "documents"), trusted).withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.leaf_hash([F.col("n_chars") + 1 if c == "n_chars" else c for c in columns])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changed)
    rows = merkle.manifest(_table(spark, sf_dir, "documents"), columns, carry={"tampered": tampered})
    siblings = F.transform(F.filter("path", lambda s: s["side"] != merkle.ALONE), lambda s: s["digest"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias(
        "proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_preferences": op8_preferences,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_divergence": op12_source_divergence,
    "op13_exact_top_k": op13_exact_top_k,
}

SQL = {
    "op7_quality_rules": quality_sql(),
    "op11_merkle_manifest": manifest_sql(),
    "op12_source_divergence": divergence_sql(),
    # double sums of whole numbers this small are exact
    "op13_exact_top_k": """
WITH vectors AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), scores AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.n <> c.n WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores) WHERE rank <= 20
""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    # the given pages hold their article in one element, with headings, paragraphs, bold text and line breaks only
    "op6_html_extraction": r"""
SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
    regexp_split_to_array(regexp_replace(article, '<br>', ' ', 'g'), '</?(?:h1|p)>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '</?b>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
    lambda x: x <> ''), ' ') AS text
  FROM (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS article FROM pages))
""",
    "op8_preferences": """
WITH convs AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), pairs AS (
  SELECT max(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (conv_id % 2 = 1) AS rejected_id
  FROM convs GROUP BY conv_id // 2
), joined AS (
  SELECT chosen_id, rejected_id, a.turns AS a, b.turns AS b,
         CASE WHEN a.turns IS NULL OR b.turns IS NULL THEN 0 ELSE len(list_filter(range(1, least(len(a.turns), len(b.turns)) + 1),
           lambda i: list_bool_and([a.turns[j].role IS NOT DISTINCT FROM b.turns[j].role
             AND a.turns[j].text IS NOT DISTINCT FROM b.turns[j].text FOR j IN range(1, i + 1)]))) END AS n
  FROM pairs LEFT JOIN convs a ON a.conv_id = chosen_id LEFT JOIN convs b ON b.conv_id = rejected_id
), parts AS (
  SELECT chosen_id, rejected_id, n, a[1:n] AS p, a[n + 1:] AS a, b[n + 1:] AS b FROM joined
)
SELECT chosen_id, rejected_id, n AS n_prompt_turns,
       coalesce(array_to_string([SHOW FOR t IN p], ''), '') AS prompt,
       CASE WHEN a IS NOT NULL THEN coalesce(array_to_string([SHOW FOR t IN a], ''), '') END AS chosen,
       CASE WHEN b IS NOT NULL THEN coalesce(array_to_string([SHOW FOR t IN b], ''), '') END AS rejected,
       CASE WHEN a IS NOT NULL THEN coalesce(array_to_string([MASK FOR t IN a], ','), '') END AS chosen_mask,
       CASE WHEN b IS NOT NULL THEN coalesce(array_to_string([MASK FOR t IN b], ','), '') END AS rejected_mask
FROM parts
""".replace("SHOW", "'<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)").replace(
        "MASK", "CASE WHEN t.role = 'assistant' THEN (13 + length(t.role)) || '+' || (11 + length(coalesce(t.text, ''))) "
        "ELSE (24 + length(coalesce(t.role, '')) + length(coalesce(t.text, ''))) || '+0' END"),
}
