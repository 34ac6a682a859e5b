"""Queries on references between the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.keys import loose_id
from tessitura.functions.times import instant_micros, month_of, ntz_micros
from tessitura.operators import orphans
from tessitura.plans.registry import register, sql_utc
from tessitura.session import table

_FOUND = (r"""
WITH docs AS (
  SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k,
         coalesce(@UTC, TIMESTAMP '0001-01-01') AS s
  FROM corpus WHERE id IS NOT NULL),
gone AS (
  SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k, removed_at AS r
  FROM corpus_removals WHERE id IS NOT NULL AND removed_at IS NOT NULL),
refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'metadata' AS ref_table, chunk_id AS ref_key,
           lower(regexp_replace(document_id, '^\s+|\s+$', '', 'g')) AS k, indexed_at AS t FROM metadata
    UNION ALL
    SELECT 'gt_questions', question_id, lower(regexp_replace(src.document_id, '^\s+|\s+$', '', 'g')), updated_at
    FROM (SELECT question_id, updated_at, unnest(relevant_sources) AS src FROM gt_questions))
  WHERE k IS NOT NULL),
known AS (SELECT DISTINCT k FROM docs),
born AS (
  SELECT r.k, r.t, max(d.s) AS s FROM (SELECT DISTINCT k, t FROM refs) r JOIN docs d ON d.k = r.k AND d.s <= r.t GROUP BY ALL),
died AS (
  SELECT r.k, r.t, max(g.r) AS r FROM (SELECT DISTINCT k, t FROM refs) r JOIN gone g ON g.k = r.k AND g.r <= r.t GROUP BY ALL),
judged AS (
  SELECT refs.ref_table, refs.ref_key, refs.k AS document_id, strftime(refs.t, '%Y-%m') AS period,
         CASE WHEN known.k IS NULL THEN 'missing' WHEN born.s IS NULL THEN 'late'
              WHEN died.r >= born.s THEN 'deleted' END AS reason
  FROM refs LEFT JOIN known ON known.k = refs.k
  LEFT JOIN born ON born.k = refs.k AND born.t = refs.t
  LEFT JOIN died ON died.k = refs.k AND died.t = refs.t)
""").replace("@UTC", sql_utc("scraped_at"))


@register(_FOUND + "SELECT DISTINCT * FROM judged WHERE reason IS NOT NULL")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, removals = table(spark, sf_dir, "corpus"), table(spark, sf_dir, "corpus_removals")
    chunks, questions = table(spark, sf_dir, "metadata"), table(spark, sf_dir, "gt_questions")
    sources = questions.select("question_id", "updated_at", F.explode("relevant_sources").alias("source"))

    def refs(df, name, key, document, time):
        return df.select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_key"), loose_id(F.col(document)).alias("key"), ntz_micros(F.col(time)).alias("time"), month_of(F.col(time)).alias("period"))

    return orphans.orphan_references(
        refs(chunks, "metadata", "chunk_id", "document_id", "indexed_at").unionByName(refs(sources, "gt_questions", "question_id", "source.document_id", "updated_at")),
        corpus.select(loose_id(F.col("id")).alias("key"), instant_micros(F.col("scraped_at")).alias("time")),
        removals.select(loose_id(F.col("id")).alias("key"), ntz_micros(F.col("removed_at")).alias("time")),
    )


@register(
    _FOUND
    + """SELECT ref_table, period, reason, count(*) AS orphans, count(DISTINCT document_id) AS documents
  FROM (SELECT DISTINCT * FROM judged WHERE reason IS NOT NULL) GROUP BY ALL"""
)
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p4_found(spark, sf_dir))
