"""The registered query of each operator, over its whole table, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from skylattice.llm import (
    conversation, decontaminate, embedding_dedup, language, line_dedup, mixing, near_dup, quality, spelling, suffix_dedup,
    toxicity, unit_dedup, warc)
from skylattice.llm.common import read, shared_folder
from skylattice.llm.sparse import fold_of


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.with_revisits(pages), path, compression="gzip")
    found = warc.read_archives(spark, path).where(F.col("record_type").isin("response", "revisit"))
    revisit = F.col("record_type") == "revisit"
    told = F.regexp_extract("payload_digest", "^sha256:(.*)$", 1)
    return found.select(
        warc.record_number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.when(revisit, told).otherwise(F.sha2("payload", 256)).alias("payload_digest"), "record_type",
        warc.record_number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_components(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "line_no", "first_doc", "first_line", "kept")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return embedding_dedup.near_duplicates(vectors).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model).select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    return language.identify(docs.select(F.col("doc_id").alias("id"), "text"), model).select(
        F.col("id").alias("doc_id"), (fold_of("id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judged(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op7_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return unit_dedup.cut(docs).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_units", "n_removed", "n_removed_bytes", "kept_sha256",
        F.concat_ws(",", F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["length"].cast("string")))).alias("removed"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return suffix_dedup.cut(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return near_dup.near_duplicates(docs, near_dup.Rule(words=3, percent=85)).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixed(docs).select(
        "doc_id", "n_tokens", "class_source", "class_lang", "class_topic", F.round("probability", 6).alias("probability"), "taken")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    found = conversation.report(conversation.damaged(rows))
    return found.select(F.col("conv").alias("conv_id"), *found.columns[1:])


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    words = spelling.vocabulary(spelling.misspelt(spelling.occurrences(docs)))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


_OP7_SQL = """
WITH units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit_no FROM documents
), sized AS (
  SELECT *, strlen(unit) AS n, sum(strlen(unit) + 1) OVER (PARTITION BY doc_id ORDER BY unit_no) - strlen(unit) - 1 AS start,
    translate(trim(regexp_replace(unit, '[ \t]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM units
), marked AS (
  SELECT *, regexp_matches(normal, '[^\\x09-\\x0D\\x20]') AND row_number() OVER (PARTITION BY normal ORDER BY doc_id, unit_no) > 1 AS gone FROM sized
)
SELECT doc_id, CAST(sum(n + 1) - 1 AS BIGINT) AS n_bytes, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
  CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed_bytes,
  sha256(coalesce(string_agg(unit, chr(10) ORDER BY unit_no) FILTER (NOT gone), '')) AS kept_sha256,
  coalesce(string_agg(start || ':' || n, ',' ORDER BY unit_no) FILTER (gone), '') AS removed
FROM marked GROUP BY doc_id
"""


def _mixing_sql(t: mixing.Targets) -> str:
    """The raking as a recursion over the cells, one marginal a step."""
    named = {m: ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in getattr(t, m).items()) for m in mixing.MARGINS}
    word, marks = mixing.WORD, mixing.MARKUP
    target = ", ".join(f"t_{m}(class, share) AS (VALUES {named[m]})" for m in mixing.MARGINS)
    shares = ", ".join(f"""h_{m} AS (
        SELECT c.class_{m} AS class, sum(n) / (SELECT sum(n) FROM cells) AS have, any_value(t.share) AS share
        FROM cells c LEFT JOIN t_{m} t ON t.class = c.class_{m} GROUP BY 1 HAVING sum(n) > 0),
      s_{m} AS (SELECT class, CASE WHEN share IS NULL THEN have ELSE share * (1 - coalesce((SELECT sum(have) FROM h_{m} WHERE share IS NULL), 0))
        / (SELECT sum(share) FROM h_{m}) END AS share FROM h_{m})""" for m in mixing.MARGINS)
    step = " ".join(f"WHEN {k} THEN share_{m} / nullif(sum(w) OVER (PARTITION BY it, class_{m}), 0)" for k, m in enumerate(mixing.MARGINS))
    return f"""
WITH RECURSIVE {target}, counted AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '{word}')) AS n_tokens,
    length(text) - length(translate(text, '{marks}', '')) AS marks FROM documents
), kinds AS (
  SELECT *, CASE WHEN coalesce(20 * marks > length(text), false) THEN 'markup' WHEN n_tokens >= {mixing.LONGFORM_WORDS} THEN 'longform'
    WHEN n_tokens >= {mixing.ARTICLE_WORDS} THEN 'article' ELSE 'note' END AS topic FROM counted
), classed AS (
  SELECT doc_id, n_tokens, {", ".join(f"CASE WHEN {m} IN (SELECT class FROM t_{m}) THEN {m} ELSE '*' END AS class_{m}" for m in mixing.MARGINS)} FROM kinds
), cells AS (
  SELECT {", ".join(f"class_{m}" for m in mixing.MARGINS)}, sum(n_tokens)::DOUBLE AS n FROM classed GROUP BY ALL
), {shares}, ipf AS (
  SELECT 0 AS it, c.*, {", ".join(f"s_{m}.share * (SELECT sum(n) FROM cells) AS share_{m}" for m in mixing.MARGINS)}, c.n AS w
  FROM cells c {" ".join(f"LEFT JOIN s_{m} ON s_{m}.class = c.class_{m}" for m in mixing.MARGINS)}
  UNION ALL
  SELECT it + 1, {", ".join(f"class_{m}" for m in mixing.MARGINS)}, n, {", ".join(f"share_{m}" for m in mixing.MARGINS)},
    w * coalesce(CASE it % 3 {step} END, 0) FROM ipf WHERE it < {3 * mixing.SWEEPS}
), ratios AS (
  SELECT *, CASE WHEN n > 0 THEN w / n ELSE 1 END AS ratio FROM ipf WHERE it = {3 * mixing.SWEEPS}
), filled AS (
  SELECT *, ({t.share!r} * (SELECT sum(n) FROM cells) - coalesce(sum(n) OVER before, 0)) / sum(n * ratio) OVER onward AS factor FROM ratios
  WINDOW before AS (ORDER BY ratio DESC, class_source, class_lang, class_topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    onward AS (ORDER BY ratio DESC, class_source, class_lang, class_topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), chosen AS (
  SELECT factor FROM filled WHERE factor * ratio <= 1 ORDER BY ratio DESC, class_source, class_lang, class_topic LIMIT 1
), table_ AS (
  SELECT *, round(greatest(0, least(1, ratio * (SELECT factor FROM chosen))), 9) AS p FROM ratios
)
SELECT d.doc_id, d.n_tokens::BIGINT AS n_tokens, class_source, class_lang, class_topic, round(t.p, 6) AS probability,
  ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < t.p AS taken
FROM classed d JOIN table_ t USING (class_source, class_lang, class_topic)
"""


QUERIES = {q.__name__: q for q in (
    op1_warc, op2_line_dedup, op3_embedding_dedup, op4_quality, op5_language, op6_decontaminate, op7_unit_dedup,
    op8_suffix_dedup, op9_near_dup, op10_mixing, op11_toxicity,
    op12_conversation_repair, op13_spelling_variants)}
ORACLES: dict[str, str] = {"op7_unit_dedup": _OP7_SQL, "op10_mixing": _mixing_sql(mixing.Targets())}
