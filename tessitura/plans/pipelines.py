"""Whole pipelines: retrieval under many configurations, answers, ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.providers import NO_CONTEXT
from tessitura.operators import ingest
from tessitura.operators import matching as M
from tessitura.operators import pipeline as P
from tessitura.operators.evaluation import set_recall
from tessitura.plans.corpus import _PARSED
from tessitura.plans.registry import register
from tessitura.plans.retrieval import _MATRIX as _PIPELINE
from tessitura.plans.retrieval import _SEARCH, _chunks, _queries, _search
from tessitura.schemas import DOCUMENT_REQUIRED
from tessitura.session import materialize, table

_WORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '[\s\p{{Z}}\x{{85}}\x1c-\x1f]+'), lambda x: x <> ''))"
# All chunks, not only those that aren't children.
_ALL = _SEARCH.replace("AND chunk_strategy <> 'hierarchical-child'", "AND chunk_strategy IS NOT NULL")
assert _ALL != _SEARCH
_MATRIX = _ALL + f"""
, cfg AS (SELECT *, greatest(coalesce(candidates_k_override, CASE WHEN rerank OR mode = 'hierarchical' OR exclude_revogadas OR exclude_superseded_versions OR restrict_to_query_submodulo THEN 50 ELSE 10 END), 10) AS pool FROM ({{configs}})),
asked AS (SELECT q.query, q.question, regexp_extract(question, '(?i)subm[óo]dulo\\s+(\\d+)\\.(\\d+)([a-z]?)', 1) || '-' || regexp_extract(question, '(?i)subm[óo]dulo\\s+(\\d+)\\.(\\d+)([a-z]?)', 2)
  || lower(regexp_extract(question, '(?i)subm[óo]dulo\\s+(\\d+)\\.(\\d+)([a-z]?)', 3)) AS module FROM q),
named AS (SELECT DISTINCT query, chunk_id FROM asked JOIN chunks ON module <> '-' AND regexp_matches(document_id, '(subm|rede-)' || module || '([^0-9a-z]|$)')),
ranked AS (SELECT query, s.chunk_id, s.score, chunk_strategy, metodo_extracao, row_number() OVER (PARTITION BY query, chunk_strategy, metodo_extracao ORDER BY score DESC, s.chunk_id) AS p FROM scored s JOIN chunks USING (chunk_id)),
pooled AS (SELECT label, query, chunk_id, score, p FROM cfg JOIN ranked USING (chunk_strategy, metodo_extracao) WHERE p <= pool),
added AS (SELECT label, query, chunk_id, 0.0::DOUBLE AS score, 1073741824 AS p FROM named JOIN chunks USING (chunk_id) JOIN cfg USING (chunk_strategy, metodo_extracao) WHERE boost_identificador OR restrict_to_query_submodulo),
every_ AS (SELECT * FROM pooled UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM pooled p WHERE p.label = a.label AND p.query = a.query AND p.chunk_id = a.chunk_id)),
kept AS (SELECT e.*, cfg.mode, cfg.rerank, c.document_id, c.parent_chunk_id, c.texto FROM every_ e JOIN cfg USING (label) JOIN chunks c USING (chunk_id)
  WHERE NOT (exclude_revogadas AND coalesce(lower(trim(c.situacao)) = 'revogada', FALSE)) AND NOT (exclude_superseded_versions AND coalesce(c.document_id IN (SELECT document_id FROM gone), FALSE))
  AND (NOT restrict_to_query_submodulo OR e.query NOT IN (SELECT query FROM named) OR EXISTS (SELECT 1 FROM named n WHERE n.query = e.query AND n.chunk_id = e.chunk_id))),
valued AS (SELECT kept.*, CASE WHEN rerank THEN round(len(list_intersect({_WORDS.format('question')}, {_WORDS.format('texto')})) / greatest(1, len({_WORDS.format('question')})), 9) ELSE score END AS value FROM kept JOIN asked USING (query)),
units AS (SELECT label, query, chunk_id, document_id, value, p FROM valued WHERE mode <> 'hierarchical' UNION ALL
  SELECT label, query, parent_chunk_id, document_id, value, p FROM (SELECT *, row_number() OVER (PARTITION BY label, query, parent_chunk_id ORDER BY value DESC, p, chunk_id) AS b FROM valued
    WHERE mode = 'hierarchical' AND parent_chunk_id IN (SELECT chunk_id FROM chunks WHERE chunk_strategy = 'hierarchical')) WHERE b = 1),
runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, query ORDER BY value DESC, p, chunk_id) AS rank FROM units) WHERE rank <= 10)
"""
_WANTED = r""", wanted AS (SELECT DISTINCT q.query, s.document_id AS document_id, coalesce(nullif(trim(s.grupo), ''), 'solo:' || pos) AS grp FROM q JOIN (
  SELECT question_id, unnest(range(len(relevant_sources))) AS pos, unnest(relevant_sources) AS s FROM gt_questions) USING (question_id)),
hits AS (SELECT label, query, count(DISTINCT grp) AS met, min(rank) AS first_rank FROM runs JOIN wanted USING (query, document_id) GROUP BY ALL),
per_query AS (SELECT l.label, q.query, coalesce(met / groups, 0) AS doc_recall, coalesce(1.0 / first_rank, 0) AS mrr, first_rank FROM q CROSS JOIN (SELECT DISTINCT label FROM runs) l
  LEFT JOIN (SELECT query, count(DISTINCT grp) AS groups FROM wanted GROUP BY query) g ON g.query = q.query LEFT JOIN hits ON hits.label = l.label AND hits.query = q.query)
"""
_FULL = """SELECT 'boosted' AS label, s AS chunk_strategy, m AS metodo_extracao, 'flat' AS mode, 80 AS candidates_k_override, TRUE AS rerank, TRUE AS exclude_revogadas, TRUE AS exclude_superseded_versions, FALSE AS restrict_to_query_submodulo, TRUE AS boost_identificador
  FROM (SELECT 'article-aware' AS s, 'texto' AS m) UNION ALL SELECT 'restricted', 'article-aware', 'texto', 'flat', NULL, FALSE, FALSE, FALSE, TRUE, FALSE UNION ALL
  SELECT 'parents', 'hierarchical-child', 'texto', 'hierarchical', NULL, FALSE, TRUE, FALSE, FALSE, FALSE"""


def _full(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same queries under three configurations that use every step between them."""
    rows = [("boosted", "article-aware", "texto", "flat", 80, True, True, True, False, True), ("restricted", "article-aware", "texto", "flat", None, False, False, False, True, False),
            ("parents", "hierarchical-child", "texto", "hierarchical", None, False, True, False, False, False)]
    configs = spark.createDataFrame(rows, "label string, chunk_strategy string, metodo_extracao string, mode string, candidates_k_override int, rerank boolean, exclude_revogadas boolean, "
        "exclude_superseded_versions boolean, restrict_to_query_submodulo boolean, boost_identificador boolean")
    queries, chunks = _queries(spark, sf_dir), _chunks(spark, sf_dir, _PIPELINE)
    return queries, chunks, P.run_configs(queries, chunks, configs)


@register(_MATRIX.replace("{configs}", _FULL) + "SELECT label, query, chunk_id, round(value, 6) AS score, CAST(rank AS INT) AS rank FROM runs")
def retrieve_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval with restriction or injection, filters, rerank and parents."""
    _, _, runs = _full(spark, sf_dir)
    return runs.select("label", "query", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register(_MATRIX.replace("{configs}", "SELECT * FROM store_configs") + _WANTED + """SELECT label, count(*) AS queries, round(avg(doc_recall), 6) AS doc_recall, round(avg(mrr), 6) AS mrr, count(first_rank) AS met FROM per_query GROUP BY label""")
def matrix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored configuration run over the query set, with its document metrics."""
    queries, chunks = _queries(spark, sf_dir), _chunks(spark, sf_dir, _PIPELINE)
    runs = materialize(P.run_configs(queries, chunks, table(spark, sf_dir, "store_configs")), "runs")
    each = P.document_metrics(runs, queries, M.expected_sources(table(spark, sf_dir, "gt_questions")))
    return each.groupBy("label").agg(F.count("*").alias("queries"), F.round(F.avg("doc_recall"), 6).alias("doc_recall"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count("first_rank").alias("met"))


@register(_SEARCH + r""", wanted AS (SELECT DISTINCT q.query, s.document_id AS document_id FROM q JOIN (SELECT question_id, unnest(relevant_sources) AS s FROM gt_questions) USING (question_id) WHERE s.document_id IS NOT NULL),
got AS (SELECT DISTINCT query, document_id FROM found JOIN chunks USING (chunk_id) WHERE rank <= 5), first AS (SELECT query, min(rank) AS r FROM found JOIN chunks USING (chunk_id) JOIN wanted USING (query, document_id) GROUP BY query)
SELECT w.query, CAST(first.r AS INT) AS first_rank, round(count(got.document_id) / count(*), 6) AS recall_at_5 FROM wanted w LEFT JOIN got ON got.query = w.query AND got.document_id = w.document_id LEFT JOIN first ON first.query = w.query GROUP BY ALL""")
def first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rank of an expected document (null without one), and the share of expected documents among the first five chunks."""
    queries, chunks, found = _search(spark, sf_dir)
    s = table(spark, sf_dir, "gt_questions").select("question_id", F.explode("relevant_sources.document_id").alias("document_id")).where("document_id is not null").distinct()
    wanted = queries.join(s, "question_id").select("query", "document_id").distinct()
    named = found.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("query", "document_id", "rank")
    lists = wanted.groupBy("query").agg(F.collect_set("document_id").alias("expected"))  # the sources of a question
    got = named.groupBy("query").agg(F.collect_set(F.when(F.col("rank") <= 5, F.col("document_id"))).alias("got"))
    first = named.join(wanted, ["query", "document_id"]).groupBy("query").agg(F.min("rank").alias("first_rank"))
    joined = lists.join(got, "query", "left").join(first, "query", "left")
    recall = F.coalesce(set_recall(F.col("got"), F.col("expected")), F.lit(0.0))
    return joined.select("query", "first_rank", F.round(recall, 6).alias("recall_at_5"))


_FLAT = r"array_to_string(list_filter(string_split_regex({}, '[\s\p{{Z}}\x{{85}}\x1c-\x1f]+'), lambda w: w <> ''), ' ')"


@register(_SEARCH + rf""", ctx AS (SELECT query, list({_FLAT.format('texto')} ORDER BY rank) AS t, list(coalesce(citation_label, '') ORDER BY rank) AS l FROM found JOIN chunks USING (chunk_id) GROUP BY query)
SELECT q.query, md5(CASE WHEN t IS NULL THEN '{NO_CONTEXT}' ELSE array_to_string(list_transform(t[1:3], lambda x: substr(x, 1, 500)), chr(10) || chr(10)) END) AS answer,
  CAST(coalesce(len(t), 0) AS INT) AS contexts, array_to_string(coalesce(l, []), ' | ') AS sources FROM q LEFT JOIN ctx ON ctx.query = q.query""")
def rag_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query answered from what is retrieved for it, with its sources."""
    queries, chunks, found = _search(spark, sf_dir)
    labels = ingest.latest_of_few(table(spark, sf_dir, "metadata").where("texto is not null and chunk_strategy is not null").select("chunk_id", "citation_label", "texto", "indexed_at"), "chunk_id", F.asc("indexed_at"), F.asc("texto"))
    made = P.answers(materialize(found, "found"), queries, labels)
    return made.select("query", F.md5("answer").alias("answer"), "contexts", F.array_join("sources", " | ").alias("sources"))


@register(f"""WITH merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, metodo_extracao ORDER BY {_PARSED} DESC, registro DESC) AS r FROM corpus) WHERE r = 1)
SELECT tipo, metodo_extracao, count(*) AS documents, count(*) FILTER (WHERE """ + " OR ".join(f"{c} IS NULL" for c in DOCUMENT_REQUIRED) + """) AS incomplete,
  count(*) FILTER (WHERE length(texto) < 100) AS short, count(*) FILTER (WHERE m.mid IS NOT NULL) AS paired FROM merged LEFT JOIN (SELECT DISTINCT id AS mid, metodo_extracao AS other FROM merged WHERE id IS NOT NULL) m
  ON m.mid = merged.id AND m.other <> merged.metodo_extracao GROUP BY tipo, metodo_extracao""")
def ingestion_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge what was collected with what is there, then what the checks find per partition to be written."""
    corpus = table(spark, sf_dir, "corpus")
    middle = corpus.agg(F.avg("registro")).first()[0] or 0.0
    merged = materialize(ingest.upsert(corpus.where(F.col("registro") <= middle), corpus.where(F.col("registro") > middle)), "merged")
    missing = ingest.any_of(*(F.col(c).isNull() for c in DOCUMENT_REQUIRED))
    # Counted per id first: both methods of an id are one group of two rows.
    methods = merged.where("id is not null").groupBy("id").agg(F.collect_set("metodo_extracao").alias("methods"))
    joined = merged.join(methods, "id", "left")
    paired = F.exists("methods", lambda m: m != F.col("metodo_extracao"))
    return joined.groupBy("tipo", "metodo_extracao").agg(
        F.count("*").alias("documents"), F.count_if(missing).alias("incomplete"), F.count_if(F.length("texto") < 100).alias("short"), F.count_if(F.coalesce(paired, F.lit(False))).alias("paired"))
