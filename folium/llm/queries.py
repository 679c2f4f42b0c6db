"""Queries of the llm operators and their SQL, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import confusables, leakage, near_duplicates, packing, sentences, splitting, toxicity, truncation
from folium.llm.common import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.found(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "settings"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "settings"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = sentences.split_rows(read(spark, sf_dir, "pages"), key="page_id").select(F.lit("pages").alias("src"), "row_id", "start_pos", "end_pos")
    return pages.unionByName(sentences.split_rows(read(spark, sf_dir, "requirements"), key="req_id").select(F.lit("requirements").alias("src"), "row_id", "start_pos", "end_pos"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(read(spark, sf_dir, "llm_results")).where("cut").select("call_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(read(spark, sf_dir, "llm_results"))


def _p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("row_id"), "text")
    return pages.unionByName(read(spark, sf_dir, "requirements").select(F.lit("requirements").alias("src"), F.col("req_id").alias("row_id"), "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.found_pairs(_p5_texts(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(_p5_texts(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = confusables.odd_rows(read(spark, sf_dir, "pages"), key="page_id", text="text").select(F.lit("pages").alias("src"), "row_id")
    return pages.unionByName(confusables.odd_rows(read(spark, sf_dir, "money_facts"), key="money_id", text="raw").select(F.lit("money_facts").alias("src"), "row_id"))


def p6_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page text and raw wording in the consistent form, once for each row id."""
    pages = confusables.normalized(read(spark, sf_dir, "pages"), key="page_id", text="text").withColumn("src", F.lit("pages"))
    both = pages.unionByName(confusables.normalized(read(spark, sf_dir, "money_facts"), key="money_id", text="raw").withColumn("src", F.lit("money_facts")))
    return both.dropDuplicates(["src", "row_id"]).select("src", "row_id", "text", "changed")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(read(spark, sf_dir, "documents"), read(spark, sf_dir, "containers"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p7_pack(spark, sf_dir))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("longest_run >= 12").select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: how many documents hold a passage of it, how many only most of its words, its longest passage in one."""
    exact = F.col("longest_run") >= 12
    return p8_leaks(spark, sf_dir).groupBy("item_id").agg(F.count_if(exact).alias("docs"), F.count_if(~exact).alias("near_docs"), F.max("longest_run").alias("longest_run"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=("source",))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flagged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(p9_scores(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p4_found, p4_rates, p5_found, p5_groups, p6_found, p6_normalized, p7_pack, p7_fill, p8_found, p8_leaks, p8_items, p9_found, p9_scores, p9_rates)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
WITH c AS (
  SELECT DISTINCT chunk_id, '\n' || replace(text, chr(13), chr(13)) || '\n' AS t0, text, s.chunk_chars AS lim
  FROM chunks JOIN settings s USING (provider) WHERE length(text) > s.chunk_chars
), m AS (
  SELECT chunk_id, lim, text, string_split_regex(chr(10) || text || chr(10), '\n(?:[ \t]*\n)+') AS b,
         string_split(text, chr(10)) AS l, string_split_regex(text, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+') AS w FROM c
)
SELECT chunk_id, CASE
  WHEN list_max(list_transform(b, lambda x: length(trim(x, chr(10))))) <= lim THEN 'blank_line'
  WHEN list_max(list_transform(l, lambda x: length(x))) <= lim THEN 'line'
  WHEN list_max(list_transform(w, lambda x: length(x))) <= lim THEN 'space' ELSE 'none' END AS boundary
FROM m
""",
        "p8_found": r"""
WITH iw AS (
  SELECT item_id, list_filter(list_transform(regexp_split_to_array(lower(replace(text, chr(173), '')), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+'),
         lambda x: regexp_replace(x, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')), lambda x: x <> '') AS w FROM eval_items
), dw AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(replace(text, chr(173), '')), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+'),
         lambda x: regexp_replace(x, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')), lambda x: x <> '') AS w FROM documents
), ig AS (SELECT DISTINCT item_id, hash(list_slice(w, k, k + 11)) AS g FROM iw, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS k)),
dg AS (SELECT DISTINCT doc_id, hash(list_slice(w, k, k + 11)) AS g FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS k))
SELECT DISTINCT doc_id, item_id FROM ig JOIN dg USING (g)
""",
    }
