"""Scores of retrieval and answers, failures, and comparisons of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CITATION_LEAST, CORRECT_LEAST = 0.5, 0.8
#: Promotion: saved per broken, and how far recall may fall.
SAVED_PER_BROKEN, RECALL_DROP = 2, 0.02

# Where to look next, by failure.
NEXT_FOCUS = {
    "retrieval_document_failure": "query_expansion_or_retrieval",
    "retrieval_passage_failure": "chunking_rerank_or_matching",
    "citation_failure": "prompt_or_citation_selection",
    "answer_quality_failure": "prompt_generator_or_ground_truth",
    "citation_and_answer_failure": "prompt_generator_or_context_use",
    "generator_failure": "generator_runtime",
    "llm_judge_missing": "rerun_with_llm_judge",
    "unknown_failure": "manual_review",
}


def histogram(value: Column) -> Column:
    """Null and empty values are ``unknown``."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def ndcg(grades: Column) -> Column:
    """Gains ``grade / log2(rank + 1)`` in order, over those of the same grades
    sorted down; negative grades count as 0, no gain at all gives 0."""
    floored = F.transform(grades, lambda g: F.greatest(g, F.lit(0)).cast("double"))
    gain = lambda a: F.aggregate(F.transform(a, lambda g, i: g / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    ideal = gain(F.sort_array(floored, asc=False))
    return F.when(ideal > 0, gain(floored) / ideal).otherwise(0.0)


def reciprocal_rank(grades: Column) -> Column:
    first = F.array_position(F.transform(grades, lambda g: g > 0), True)
    return F.when(first > 0, 1.0 / first).otherwise(0.0)


def precision(grades: Column) -> Column:
    """Over the number returned, not the number asked for."""
    n = F.size(grades)
    return F.when(n > 0, F.size(F.filter(grades, lambda g: g > 0)) / n).otherwise(0.0)


def set_recall(found: Column, expected: Column) -> Column:
    n = F.size(F.array_distinct(expected))
    return F.when(n > 0, F.size(F.array_intersect(found, expected)) / n).otherwise(0.0)


def citation_precision(cited: Column, relevant: Column) -> Column:
    n = F.size(F.array_distinct(cited))
    return F.when((n > 0) & (F.size(relevant) > 0), F.size(F.array_intersect(cited, relevant)) / n).otherwise(0.0)


def citation_recall(citations: Column, expected: Column) -> Column:
    """Share of the expected references that occur in the citations."""
    joined = F.array_join(citations, "\n")
    held = F.filter(expected, lambda e: F.contains(joined, e))
    return F.when(F.size(expected) > 0, F.size(held) / F.size(expected)).otherwise(0.0)


def usable(recall: Column, citation: Column, correctness: Column) -> Column:
    return F.coalesce((recall > 0) & (citation >= CITATION_LEAST) & (correctness >= CORRECT_LEAST), F.lit(False))


def failure_type(is_usable: Column, generator: Column, recall: Column, doc_recall: Column, citation: Column, correctness: Column) -> Column:
    """The first of the ordered causes that holds."""
    low_citation, low_answer = citation < CITATION_LEAST, correctness < CORRECT_LEAST
    return (
        F.when(is_usable, "usable")
        .when(generator.isNotNull() & (generator != "ok"), "generator_failure")
        .when((recall <= 0) & (doc_recall <= 0), "retrieval_document_failure")
        .when((recall <= 0) & (doc_recall > 0), "retrieval_passage_failure")
        .when(correctness.isNull(), "llm_judge_missing")
        .when(low_citation & low_answer, "citation_and_answer_failure")
        .when(low_citation, "citation_failure")
        .when(low_answer, "answer_quality_failure")
        .otherwise("unknown_failure")
    )


def next_focus(failure: Column) -> Column:
    pairs = [F.lit(x) for kv in NEXT_FOCUS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), failure), F.lit("manual_review"))


def last_results(results: DataFrame) -> DataFrame:
    """One row per configuration and question: the last loaded, then last recorded."""
    order = [F.desc_nulls_last("loaded_at"), F.desc_nulls_last("recorded_at"), F.xxhash64(*sorted(results.columns))]
    rank = F.row_number().over(Window.partitionBy("config", "question_id").orderBy(*order))
    return results.where("config is not null and question_id is not null").withColumn("_r", rank).where("_r = 1").drop("_r")


def bucket(before: Column, after: Column, failure_before: Column, failure_after: Column) -> Column:
    same = histogram(failure_before) == histogram(failure_after)
    return (
        F.when(before & after, "stable_pass").when(~before & after, "saved").when(before & ~after, "broken")
        .when(same, "stable_fail_same_type").otherwise("stable_fail_changed_type")
    )


def pair_results(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Question by question, two configurations of each pair (``pair, before,
    after``): inner join, with the bucket of each question."""
    keep = ("question_id", "answer_usable", "failure_type", "doc_recall_at_k", "recall_at_k")
    side = lambda s: results.select(F.col("config").alias(s), "question_id", *(F.col(c).alias(f"{c}_{s}") for c in keep[1:]))
    joined = pairs.join(side("before"), "before").join(side("after"), ["after", "question_id"])
    ok = lambda s: F.coalesce(F.col(f"answer_usable_{s}"), F.lit(False))
    return joined.withColumn("bucket", bucket(ok("before"), ok("after"), F.col("failure_type_before"), F.col("failure_type_after")))


def verdicts(paired: DataFrame) -> DataFrame:
    """Per pair the buckets, changes and whether to promote, with reasons."""
    n = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    change = lambda c: F.round(F.avg(f"{c}_after") - F.avg(f"{c}_before"), 6)
    doc = lambda s: F.count_if(F.col(f"failure_type_{s}") == "retrieval_document_failure")
    sums = paired.groupBy("pair").agg(
        F.count("*").alias("questions"), n("saved"), n("broken"), n("stable_pass"), n("stable_fail_same_type"), n("stable_fail_changed_type"),
        change("doc_recall_at_k").alias("doc_recall_change"), (doc("after") - doc("before")).alias("doc_failure_change"))
    enough = F.col("saved") >= SAVED_PER_BROKEN * F.col("broken")
    held = F.coalesce(F.col("doc_recall_change") >= -RECALL_DROP, F.lit(True))
    reasons = F.array_compact(F.array(F.when(~enough, "saved_below_twice_broken"), F.when(~held, "doc_recall_drop")))
    return sums.withColumn("verdict", F.when(enough & held, "promote").otherwise("keep")).withColumn("reasons", F.array_join(reasons, ","))


def question_asymmetry(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Questions that only one configuration of a pair has: ``pair, question_id, side``."""
    ids = results.select("config", "question_id").distinct()
    a = pairs.join(ids, F.col("before") == F.col("config")).select("pair", "question_id", F.lit(True).alias("has_before"))
    b = pairs.join(ids, F.col("after") == F.col("config")).select("pair", "question_id", F.lit(True).alias("has_after"))
    both = a.join(b, ["pair", "question_id"], "full_outer").where("has_before is null or has_after is null")
    return both.select("pair", "question_id", F.when(F.col("has_before").isNull(), "after").otherwise("before").alias("side"))


def article_hit(found: Column, expected: Column) -> Column:
    """1 if any ``document::article`` is among the expected ones; nulls are ignored."""
    return F.coalesce(F.arrays_overlap(F.array_compact(found), F.array_compact(expected)), F.lit(False)).cast("double")


def status_accuracy(statuses: Column, expected: Column) -> Column:
    """Share of the contexts that have the expected status, whatever its case; 0 without one."""
    same = F.filter(statuses, lambda s: F.lower(s) == F.lower(expected))
    return F.when(F.coalesce(expected, F.lit("")) == "", 0.0).when(F.size(statuses) == 0, 0.0).otherwise(F.size(same) / F.size(statuses))


def hard_break(before: Column, after: Column, doc_before: Column, doc_after: Column) -> Column:
    """Usable before and not after while document recall fell; unknown recall counts as fallen."""
    return before & ~after & F.coalesce(doc_after < doc_before - 1e-9, F.lit(True))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in an order that depends on key and seed only: a sampling operator."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def fingerprint(*columns: str) -> Column:
    """Digest of named values in the order of their names: equal settings, equal digest."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def run_manifest(run_id: str, metrics: DataFrame, configs: DataFrame, label: str = "config") -> DataFrame:
    """``run_id, manifest``: the metrics of a run's configurations with their settings, as JSON."""
    joined = metrics.join(configs.withColumnRenamed("label", label), label)
    return joined.select(F.lit(run_id).alias("run_id"), F.to_json(F.struct(*joined.columns)).alias("manifest"))
