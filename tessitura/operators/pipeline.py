"""The retrieval pipeline: pool, restriction, injection, filters, rerank, parents, ranks; for many configurations at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.operators import retrieval as R
from tessitura.session import materialize

#: Switches of a configuration, with what they are where a table lacks them.
SWITCHES = ("rerank", "exclude_revogadas", "exclude_superseded_versions", "restrict_to_query_submodulo", "boost_identificador")


def _part() -> Column:
    return F.concat_ws("|", "chunk_strategy", "metodo_extracao")


def candidates(queries: DataFrame, chunks: DataFrame, configs: DataFrame, k: int) -> DataFrame:
    """``label, query, chunk_id, score, pos``: each configuration's pool of the
    chunks of its strategy and method.  Each part is searched once, with the
    largest pool that one of its configurations wants."""
    configs = configs.withColumn("part", _part()).withColumn("pool", R.pool_size_column(k))
    most = configs.agg(F.max("pool")).first()[0] or k  # one row per configuration
    asked = queries.join(configs.select("part").distinct()).select("query", "vector", "part")  # queries x parts, a few
    found = R.exact_top_k(asked, chunks.select(F.col("chunk_id").alias("item"), "vector", _part().alias("part")), most)
    pools = found.join(configs, "part").where(F.col("rank") <= F.col("pool"))
    return pools.select("label", "query", F.col("item").alias("chunk_id"), "score", F.col("rank").alias("pos"))


def run_configs(queries: DataFrame, chunks: DataFrame, configs: DataFrame, k: int = 10) -> DataFrame:
    """``label, query, chunk_id, document_id, score, rank``: what each
    configuration retrieves for each query.

    ``queries``: ``query, question, vector``; ``chunks``: ``chunk_id,
    document_id, chunk_strategy, metodo_extracao, parent_chunk_id, situacao,
    texto, vector``; ``configs``: rows with ``label``, the chunk's strategy and
    method, ``mode``, ``candidates_k_override`` and ``SWITCHES`` (null is off).

    A query that names a submodule may be restricted to its documents, or have
    their chunks added with score 0; then revoked and superseded documents
    fall out as the configuration says, the rest is scored by shared words
    where it reranks, children of a hierarchy give way to their parents, and
    the best ``k`` are ranked, ties by the order of the pool.
    """
    configs = configs.select("label", "chunk_strategy", "metodo_extracao", "mode", "candidates_k_override", *(F.coalesce(s, F.lit(False)).alias(s) for s in SWITCHES))
    plain = chunks.select("chunk_id", "document_id", "situacao", "parent_chunk_id", "chunk_strategy", "metodo_extracao")
    pool = materialize(candidates(queries, chunks, configs, k), "pool")
    named = materialize(R.of_named_module(queries, plain), "named")
    # Chunks of a named submodule join the pools of configurations that boost or are restricted to it.
    wanting = configs.where("boost_identificador or restrict_to_query_submodulo").withColumn("part", _part()).select("label", "part")
    added = named.join(plain.select("chunk_id", _part().alias("part")), "chunk_id").join(wanting, "part").select("label", "query", "chunk_id")
    added = added.join(pool, ["label", "query", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0)).withColumn("pos", F.lit(1 << 30))
    every = pool.unionByName(added).join(configs.drop("chunk_strategy", "metodo_extracao", "candidates_k_override"), "label")
    asks = named.select("query").distinct().withColumn("asks", F.lit(True))
    every = every.join(asks, "query", "left").join(named.withColumn("met", F.lit(True)), ["query", "chunk_id"], "left")
    every = every.where(~F.col("restrict_to_query_submodulo") | F.col("asks").isNull() | F.col("met"))
    every = every.join(plain.drop("chunk_strategy", "metodo_extracao"), "chunk_id").where(~F.col("exclude_revogadas") | R.passes_status(F.col("situacao")))
    gone = R.superseded(plain.select("document_id")).select("document_id", F.lit(True).alias("gone"))
    every = every.join(gone, "document_id", "left").where(~F.col("exclude_superseded_versions") | F.col("gone").isNull())
    scored = rescored(every.where("rerank"), queries, chunks).unionByName(every.where("not rerank").withColumn("value", F.col("score")))
    parents = plain.where("chunk_strategy = 'hierarchical'").select(F.col("chunk_id").alias("parent_chunk_id"), F.lit(True).alias("known"))
    flat, deep = scored.where("mode <> 'hierarchical'"), scored.where("mode = 'hierarchical'").join(parents, "parent_chunk_id", "left_semi")
    best = Window.partitionBy("label", "query", "parent_chunk_id").orderBy(F.desc("value"), "pos", "chunk_id")
    deep = deep.withColumn("b", F.row_number().over(best)).where("b = 1").withColumn("chunk_id", F.col("parent_chunk_id")).drop("b")
    w = Window.partitionBy("label", "query").orderBy(F.desc("value"), "pos", "chunk_id")
    ranked = flat.unionByName(deep.select(flat.columns)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("label", "query", "chunk_id", "document_id", F.col("value").alias("score"), "rank")


def rescored(pool: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``pool`` with ``value``: the share of the query's words that a chunk has, scored once per pair."""
    pairs = pool.select("query", "chunk_id").distinct()
    texts = pairs.join(queries.select("query", "question"), "query").join(chunks.select("chunk_id", "texto"), "chunk_id")
    values = texts.select("query", "chunk_id", F.round(R.lexical_share(F.col("question"), F.col("texto")), 9).alias("value"))
    return pool.join(values, ["query", "chunk_id"])


def document_metrics(runs: DataFrame, queries: DataFrame, sources: DataFrame) -> DataFrame:
    """``label, query, doc_recall, mrr, first_rank``: of the groups of expected
    sources those with a document retrieved, and the first rank of an expected
    document (null without one).  ``queries`` has ``query, question_id``."""
    wanted = queries.join(sources.select("question_id", "document_id", "grp").distinct(), "question_id")
    groups = wanted.groupBy("query").agg(F.countDistinct("grp").alias("groups"))
    hits = runs.join(wanted, ["query", "document_id"]).groupBy("label", "query").agg(F.countDistinct("grp").alias("met"), F.min("rank").alias("first_rank"))
    each = queries.select("query").join(runs.select("label").distinct()).join(groups, "query", "left").join(hits, ["label", "query"], "left")  # a few labels
    return each.select(
        "label", "query", F.coalesce(F.col("met") / F.col("groups"), F.lit(0.0)).alias("doc_recall"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), "first_rank")


def answers(found: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query, answer, contexts, sources``: the extractive answer from the
    best three contexts, and the labels of all contexts by their number."""
    from tessitura.functions.providers import extractive_answer

    texts = found.select("query", "chunk_id", "rank").join(chunks.select("chunk_id", "texto", "citation_label"), "chunk_id")
    held = texts.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "texto", "citation_label"))).alias("c"))  # k at most
    each = queries.select("query").join(held, "query", "left").withColumn("c", F.coalesce("c", F.expr("cast(array() as array<struct<rank:int,texto:string,citation_label:string>>)")))
    return each.select("query", extractive_answer(F.transform("c", lambda x: x["texto"])).alias("answer"), F.size("c").alias("contexts"), F.transform("c", lambda x: F.coalesce(x["citation_label"], F.lit(""))).alias("sources"))
