"""Which retrieved chunks are relevant to which expected sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions import text as T

MATCH_SHARE = 0.60


def expected_sources(questions: DataFrame, group_col: str = "grupo") -> DataFrame:
    """One row per expected source of a question: ``question_id, pos,
    document_id, signature, excerpt_tokens, grade, grp``; sources without a
    group are groups of their own."""
    s = questions.select("question_id", F.posexplode("relevant_sources").alias("pos", "s"))
    return s.select(
        "question_id", "pos", F.col("s.document_id").alias("document_id"), T.label_signature(F.col("s.section_label")).alias("signature"),
        T.informative(F.col("s.support_excerpt")).alias("excerpt_tokens"), T.grade(F.col("s.relevance")).alias("grade"),
        F.coalesce(T.or_null(F.trim(f"s.{group_col}")), F.concat(F.lit("solo:"), F.col("pos").cast("string"))).alias("grp"),
    )


def is_relevant(chunk_signature: Column, source_signature: Column, excerpt: Column, chunk_tokens: Column) -> Column:
    """By section, or by the share of the excerpt that the chunk has."""
    share = F.when(F.size(excerpt) > 0, T.coverage(excerpt, chunk_tokens, 0.0)).otherwise(0.0)
    return T.signatures_match(chunk_signature, source_signature) | F.coalesce(share >= MATCH_SHARE, F.lit(False))


def judged(retrieved: DataFrame, sources: DataFrame) -> DataFrame:
    """Retrieved chunks (``query, question_id, rank, document_id, signature,
    tokens``) joined with the sources of their document: ``hit`` says whether
    the source is met. An equi-join on question and document."""
    r, s = retrieved.alias("r"), sources.alias("s")
    met = is_relevant(F.col("r.signature"), F.col("s.signature"), F.col("s.excerpt_tokens"), F.col("r.tokens"))
    joined = r.join(s, (F.col("r.question_id") == F.col("s.question_id")) & (F.col("r.document_id") == F.col("s.document_id")))
    return joined.select("r.query", "r.question_id", "r.rank", "s.pos", "s.grp", F.when(met, F.col("s.grade")).otherwise(0).alias("grade"), met.alias("hit"))


def grades(retrieved: DataFrame, judgements: DataFrame) -> DataFrame:
    """``query, grades``: the largest grade of every retrieved chunk, in rank order."""
    best = judgements.groupBy("query", "rank").agg(F.max("grade").alias("grade"))
    each = retrieved.select("query", "rank").join(best, ["query", "rank"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("grade", F.lit(0)).alias("grade"))))
    return each.groupBy("query").agg(F.transform(ordered, lambda x: x["grade"]).alias("grades"))


def group_coverage(queries: DataFrame, sources: DataFrame, hits: DataFrame, out: str) -> DataFrame:
    """Share of a question's groups of which any source is hit (``hits``:
    ``query, question_id, grp``); questions without groups have 0."""
    groups = queries.select("query", "question_id").join(sources.select("question_id", "grp").distinct(), "question_id", "left")
    found = hits.select("query", "grp").distinct().withColumn("found", F.lit(1.0))
    joined = groups.join(found, ["query", "grp"], "left")
    share = F.avg(F.when(F.col("grp").isNotNull(), F.coalesce("found", F.lit(0.0))))
    return joined.groupBy("query").agg(F.coalesce(share, F.lit(0.0)).alias(out))
