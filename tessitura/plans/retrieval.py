"""Queries on vectors, versions and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.functions.keys import loose_id
from tessitura.operators import evaluation as E
from tessitura.operators import matching as M
from tessitura.operators import retrieval as R
from tessitura.operators.ingest import latest_of_few
from tessitura.plans.evaluation import _TOKENS
from tessitura.plans.registry import register
from tessitura.session import materialize, table

_KNN = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
scored AS (SELECT q.vec_id AS query, q.label AS wanted, i.vec_id AS item, i.label AS label, round(list_cosine_similarity(q.e, i.e), 9) AS score
  FROM v q JOIN v i ON q.vec_id % 100 = 0 AND i.vec_id <> q.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM scored) WHERE rank <= 10)
"""


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").cast("long").alias("query"), F.col("embedding").alias("vector"))
    return R.exact_top_k(queries, e.select(F.col("vec_id").cast("long").alias("item"), F.col("embedding").alias("vector")), 10)


@register(_KNN + "SELECT query, item, score, CAST(rank AS INT) AS rank FROM top")
def knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir)


@register(_KNN + """, graded AS (SELECT query, rank, CAST(label = wanted AS INT) AS g FROM top),
each AS (SELECT query, avg(g) AS precision, coalesce(1.0 / min(rank) FILTER (WHERE g > 0), 0) AS rr,
  CASE WHEN sum(g) > 0 THEN sum(g / log2(rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= sum(g)) ELSE 0 END AS ndcg FROM graded GROUP BY query)
SELECT count(*) AS queries, round(avg(precision), 6) AS precision_at_10, round(avg(rr), 6) AS mrr_at_10, round(avg(ndcg), 6) AS ndcg_at_10 FROM each""")
def knn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label")
    top = _knn(spark, sf_dir).join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("wanted")), "query")
    graded = top.join(labels.withColumnRenamed("vec_id", "item"), "item").select("query", "rank", (F.col("label") == F.col("wanted")).cast("int").alias("g"))
    lists = graded.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "g"))), lambda x: x["g"]).alias("g"))
    mean = lambda c: F.round(F.avg(c), 6)
    g = F.col("g")
    return lists.agg(F.count("*").alias("queries"), mean(E.precision(g)).alias("precision_at_10"), mean(E.reciprocal_rank(g)).alias("mrr_at_10"), mean(E.ndcg(g)).alias("ndcg_at_10"))


@register("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(R.norm(F.col("embedding")), 6).alias("norm"))


@register("""WITH u AS (SELECT label, vec_id, unnest(range(64)) AS d, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
s AS (SELECT label, d, sum(e[d + 1] / n) AS s FROM u GROUP BY ALL), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT c.label, max(c.n) AS n, round((sum(s * s) - max(c.n)) / (max(c.n) * (max(c.n) - 1)), 6) AS mean_cosine FROM s JOIN c ON c.label = s.label WHERE c.n > 1 GROUP BY c.label""")
def label_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of unlike pairs of a label, from the sum of its unit vectors: no pairs are made."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode(R.unit(F.col("embedding"))).alias("d", "x"))
    sums = rows.groupBy("label", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n")).where("n > 1")
    return whole.select("label", "n", F.round((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


_HASHED = r"""t AS (SELECT {key}, unnest(list_filter(string_split_regex(lower({text}), '[\s\p{{Z}}\x{{85}}\x1c-\x1f]+'), lambda x: x <> '')) AS token FROM {source}),
d AS (SELECT {key}, CAST(CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) % 64 AS INT) AS dim, count(*) AS n FROM t GROUP BY ALL)"""


@register("WITH " + _HASHED.format(key="question_id", text="question", source="gt_questions WHERE question IS NOT NULL")
    + " SELECT question_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY question_id)), 6) AS value FROM d")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = R.hash_embedding(table(spark, sf_dir, "gt_questions"), "question_id", "question")
    return made.select("question_id", "dim", F.round("value", 6).alias("value"))


_VERSIONS = r"""WITH ids AS (SELECT DISTINCT lower(trim(document_id)) AS document_id FROM metadata WHERE document_id IS NOT NULL),
v AS (SELECT document_id, regexp_extract(document_id, 'subm(\d+-\d+[a-z]?)-', 1) AS module, CAST(regexp_extract(document_id, '-v-(\d+)-(\d+)([a-z]?)(?:-|$)', 1) AS INT) AS major,
  CAST(regexp_extract(document_id, '-v-(\d+)-(\d+)([a-z]?)(?:-|$)', 2) AS INT) AS minor, regexp_extract(document_id, '-v-(\d+)-(\d+)([a-z]?)(?:-|$)', 3) AS suffix,
  regexp_matches(document_id, '-(aren|adsp)\d+') AS official FROM ids
  WHERE regexp_matches(document_id, 'subm\d+-\d+[a-z]?-') AND regexp_matches(document_id, '-v-\d+-\d+[a-z]?(-|$)')),
top AS (SELECT *, rank() OVER (PARTITION BY module ORDER BY major DESC, minor DESC, suffix DESC) AS r FROM v)
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "metadata").select(loose_id(F.col("document_id")).alias("document_id")).where("document_id is not null").distinct()


@register(_VERSIONS + "SELECT DISTINCT module, major, minor, suffix FROM top WHERE r = 1")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _documents(spark, sf_dir).select(T.module_key(F.col("document_id")).alias("module"), T.version(F.col("document_id")).alias("v"))
    return v.where("module is not null and v is not null").groupBy("module").agg(F.max("v").alias("v")).select("module", "v.*")


@register(_VERSIONS + """SELECT document_id, module FROM (SELECT *, bool_or(official) FILTER (WHERE r = 1) OVER (PARTITION BY module) AS any_official FROM top)
WHERE NOT (r = 1 AND (official OR NOT any_official))""")
def superseded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.superseded(_documents(spark, sf_dir))


@register(r"""WITH q AS (SELECT question_id, regexp_extract(question, '(?i)subm[óo]dulo\s+(\d+)\.(\d+)([a-z]?)', 1) || '-' || regexp_extract(question, '(?i)subm[óo]dulo\s+(\d+)\.(\d+)([a-z]?)', 2)
  || lower(regexp_extract(question, '(?i)subm[óo]dulo\s+(\d+)\.(\d+)([a-z]?)', 3)) AS module FROM gt_questions WHERE regexp_matches(question, '(?i)subm[óo]dulo\s+\d+\.\d+')),
d AS (SELECT DISTINCT lower(trim(document_id)) AS document_id FROM metadata)
SELECT question_id, module, document_id FROM q JOIN d ON regexp_matches(document_id, '(subm|rede-)' || module || '([^0-9a-z]|$)')""")
def module_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the submodule that a question names: joined on the module,
    the boundary rule checked on what is joined."""
    q = table(spark, sf_dir, "gt_questions").select("question_id", T.query_module(F.col("question")).alias("module")).where("module is not null")
    named = F.array_distinct(F.regexp_extract_all("document_id", F.lit(r"(?:subm|rede-)(\d+-\d+[a-z]?)(?![0-9a-z])"), 1))
    d = _documents(spark, sf_dir).select("document_id", F.explode(named).alias("module"))
    return q.join(d, "module").where(T.matches_module(F.col("document_id"), F.col("module"))).select("question_id", "module", "document_id").distinct()


_CHUNK = ("chunk_id", "document_id", "situacao")
_MATRIX = ("chunk_strategy", "metodo_extracao", "parent_chunk_id", "texto")
_STRUCTURE = ("texto", "artigo", "paragrafo", "inciso", "alinea")


def _chunks(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = (), condition: str = "chunk_strategy is not null") -> DataFrame:
    """Every chunk with a text once, with its hash embedding and the wanted
    columns; written, as searches read it several times."""
    rows = table(spark, sf_dir, "metadata").where("texto is not null").where(condition).select(*dict.fromkeys((*_CHUNK, *columns, "texto", "indexed_at")))
    first = latest_of_few(rows, "chunk_id", F.asc("indexed_at"), F.asc("texto"))
    made = first.withColumn("document_id", loose_id(F.col("document_id"))).withColumn("vector", R.hash_vector(F.col("texto")))
    return materialize(made.select(*_CHUNK, *columns, "vector"), "chunks")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every audited answer whose id is divisible by 100."""
    rows = table(spark, sf_dir, "gt_audit_passing_sample").where("sample_id % 100 = 0 and question is not null")
    return rows.select(F.col("sample_id").alias("query"), "question_id", "question").withColumn("vector", R.hash_vector(F.col("question")))


def _allowed(pool: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Candidates in force and of versions that aren't superseded."""
    gone = R.superseded(chunks.select("document_id")).select("document_id")
    return pool.join(chunks.select("chunk_id", "document_id", "situacao", *columns), "chunk_id").where(R.passes_status(F.col("situacao"))).join(gone, "document_id", "left_anti")


def _search(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, chunks, and each query's ten best chunks in force by hash embedding."""
    queries = _queries(spark, sf_dir)
    chunks = _chunks(spark, sf_dir, columns, "chunk_strategy <> 'hierarchical-child'")
    pool = R.exact_top_k(queries, chunks.select(F.col("chunk_id").alias("item"), "vector"), R.pool_size(10, widened=True)).withColumnRenamed("item", "chunk_id").drop("rank")
    return queries.drop("vector"), chunks, R.best_first(_allowed(pool, chunks).select("query", "chunk_id", "score"), 10)


_SEARCH = ("WITH q AS (SELECT sample_id AS query, question_id, question FROM gt_audit_passing_sample WHERE sample_id % 100 = 0 AND question IS NOT NULL), "
    "chunks AS (SELECT * REPLACE (lower(trim(document_id)) AS document_id) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at, texto) AS r FROM metadata "
    "WHERE texto IS NOT NULL AND chunk_strategy <> 'hierarchical-child') WHERE r = 1), "
    + _HASHED.format(key="query", text="question", source="q").replace("t AS", "qt AS").replace("d AS (", "qd AS (").replace("FROM t ", "FROM qt ") + ", "
    + _HASHED.format(key="chunk_id", text="texto", source="chunks").replace("t AS", "ct AS", 1).replace("d AS (", "cd AS (").replace("FROM t ", "FROM ct ")
    + """, qn AS (SELECT query, dim, n / sqrt(sum(n * n) OVER (PARTITION BY query)) AS x FROM qd), cn AS (SELECT chunk_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS x FROM cd),
scored AS (SELECT query, chunk_id, round(sum(qn.x * cn.x), 9) AS score FROM qn JOIN cn USING (dim) GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS p FROM scored) WHERE p <= 50),
""" + _VERSIONS.replace("WITH ids AS (SELECT DISTINCT lower(trim(document_id)) AS document_id FROM metadata WHERE document_id IS NOT NULL)", "ids AS (SELECT DISTINCT document_id FROM chunks WHERE document_id IS NOT NULL)")
    + """, gone AS (SELECT document_id FROM (SELECT *, bool_or(official) FILTER (WHERE r = 1) OVER (PARTITION BY module) AS any_official FROM top) WHERE NOT (r = 1 AND (official OR NOT any_official))),
found AS (SELECT * FROM (SELECT pool.query, pool.chunk_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, pool.chunk_id) AS rank FROM pool JOIN chunks USING (chunk_id)
  WHERE NOT coalesce(lower(trim(situacao)) = 'revogada', FALSE) AND document_id NOT IN (SELECT document_id FROM gone)) WHERE rank <= 10)
""")


@register(_SEARCH + "SELECT query, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM found")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, found = _search(spark, sf_dir)
    return found.select("query", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register(_SEARCH + r""", src AS (SELECT question_id, unnest(range(len(relevant_sources))) AS pos, unnest(relevant_sources) AS s FROM gt_questions),
grp AS (SELECT question_id, s.document_id AS document_id, coalesce(nullif(trim(s.grupo), ''), 'solo:' || pos) AS grp FROM src),
hit AS (SELECT DISTINCT q.query, grp FROM found JOIN chunks USING (chunk_id) JOIN q USING (query) JOIN grp ON grp.question_id = q.question_id AND grp.document_id = chunks.document_id)
SELECT query, round(coalesce(avg(CASE WHEN g.grp IS NOT NULL THEN CAST(hit.grp IS NOT NULL AS INT) END), 0), 6) AS doc_recall FROM q LEFT JOIN (SELECT DISTINCT question_id, grp FROM grp) g USING (question_id)
LEFT JOIN hit USING (query, grp) GROUP BY query""")
def document_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks, found = _search(spark, sf_dir)
    sources = M.expected_sources(table(spark, sf_dir, "gt_questions"))
    named = found.join(chunks.select("chunk_id", "document_id"), "chunk_id").join(queries.select("query", "question_id"), "query")
    hits = named.join(sources.select("question_id", "document_id", "grp"), ["question_id", "document_id"]).select("query", "question_id", "grp")
    return M.group_coverage(queries, sources, hits, "doc_recall").select("query", F.round("doc_recall", 6).alias("doc_recall"))


_SIGNATURE = """concat_ws('.', 'art' || nullif(lower(regexp_extract(coalesce(artigo, ''), '(\\d+)', 1)), ''), 'par' || nullif(lower(regexp_extract(coalesce(paragrafo, ''), '(\\d+)', 1)), ''),
  'inc' || nullif(lower(regexp_extract(coalesce(inciso, ''), '(?i)([ivxlcdm]+)', 1)), ''), 'ali' || nullif(lower(regexp_extract(coalesce(alinea, ''), '(?i)([a-z])', 1)), ''))"""
_LABEL = """concat_ws('.', 'art' || nullif(lower(regexp_extract(s.section_label, '(?i)art\\.?\\s*([0-9]+(?:[.\\-][0-9]+)?)', 1)), ''), 'par' || nullif(lower(regexp_extract(s.section_label, '(?i)(?:§|paragrafo|paragraph)\\s*([0-9]+)', 1)), ''),
  'inc' || nullif(lower(regexp_extract(s.section_label, '(?i)inciso\\s+([ivxlcdm0-9]+)', 1)), ''), 'ali' || nullif(lower(regexp_extract(s.section_label, '(?i)al[ií]nea\\s+([a-z])', 1)), ''))"""


@register(_SEARCH + f""", src AS (SELECT question_id, s.document_id AS document_id, {_LABEL} AS sig, {_TOKENS('s.support_excerpt')} AS n, greatest(1, least(3, coalesce(nullif(s.relevance, 0), 1))) AS grade, coalesce(nullif(trim(s.grupo), ''), 'solo:' || pos) AS grp
  FROM (SELECT question_id, unnest(range(len(relevant_sources))) AS pos, unnest(relevant_sources) AS s FROM gt_questions)),
ret AS (SELECT found.query, q.question_id, rank, document_id, {_SIGNATURE} AS sig, {_TOKENS('texto')} AS h FROM found JOIN chunks USING (chunk_id) JOIN q USING (query)),
judged AS (SELECT ret.query, rank, grp, grade, coalesce((src.sig <> '' AND ret.sig <> '' AND (src.sig = ret.sig OR starts_with(src.sig, ret.sig || '.') OR starts_with(ret.sig, src.sig || '.')))
  OR (len(n) > 0 AND len(list_filter(n, lambda x: list_contains(h, x))) / len(n) >= 0.6), FALSE) AS hit FROM ret JOIN src ON src.question_id = ret.question_id AND src.document_id = ret.document_id),
best AS (SELECT found.query, found.rank, coalesce(max(CASE WHEN hit THEN grade END), 0) AS g FROM found LEFT JOIN judged ON judged.query = found.query AND judged.rank = found.rank GROUP BY ALL),
ideal AS (SELECT query, g, row_number() OVER (PARTITION BY query ORDER BY g DESC) AS i FROM best),
sc AS (SELECT query, avg(CAST(g > 0 AS INT)) AS precision, coalesce(1.0 / min(rank) FILTER (WHERE g > 0), 0) AS mrr, sum(g / log2(rank + 1)) AS dcg FROM best GROUP BY query),
idc AS (SELECT query, sum(g / log2(i + 1)) AS dcg FROM ideal GROUP BY query),
rec AS (SELECT q.query, coalesce(avg(CASE WHEN g.grp IS NOT NULL THEN CAST(h.grp IS NOT NULL AS INT) END), 0) AS recall FROM q LEFT JOIN (SELECT DISTINCT question_id, grp FROM src) g USING (question_id)
  LEFT JOIN (SELECT DISTINCT query, grp FROM judged WHERE hit) h ON h.query = q.query AND h.grp = g.grp GROUP BY q.query)
SELECT query, rec.recall, coalesce(round(precision, 6), 0) AS precision, coalesce(round(mrr, 6), 0) AS mrr, coalesce(round(CASE WHEN idc.dcg > 0 THEN sc.dcg / idc.dcg ELSE 0 END, 6), 0) AS ndcg FROM rec LEFT JOIN sc USING (query) LEFT JOIN idc USING (query)""")
def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: share of source groups met, precision, reciprocal rank and nDCG of the graded chunks."""
    queries, chunks, found = _search(spark, sf_dir, _STRUCTURE)
    found = materialize(found, "found")
    sources = M.expected_sources(table(spark, sf_dir, "gt_questions"))
    signature = T.chunk_signature(*(F.col(c) for c in ("artigo", "paragrafo", "inciso", "alinea"))).alias("signature")
    retrieved = found.join(chunks.select("chunk_id", "document_id", signature, T.informative(F.col("texto")).alias("tokens")), "chunk_id").join(queries.select("query", "question_id"), "query")
    judged = materialize(M.judged(retrieved, sources), "judged")
    graded = M.grades(found, judged)
    g = F.col("grades")
    scores = graded.select("query", F.round(E.precision(g), 6).alias("precision"), F.round(E.reciprocal_rank(g), 6).alias("mrr"), F.round(E.ndcg(g), 6).alias("ndcg"))
    recall = M.group_coverage(queries, sources, judged.where("hit").select("query", "question_id", "grp"), "recall")
    return recall.join(scores, "query", "left").na.fill(0.0)


@register("""SELECT question_id, pos, signature, grade, grp FROM (SELECT question_id, CAST(pos AS INT) AS pos,
  concat_ws('.', 'art' || nullif(lower(regexp_extract(s.section_label, '(?i)art\\.?\\s*([0-9]+(?:[.\\-][0-9]+)?)', 1)), ''), 'par' || nullif(lower(regexp_extract(s.section_label, '(?i)(?:§|paragrafo|paragraph)\\s*([0-9]+)', 1)), ''),
   'inc' || nullif(lower(regexp_extract(s.section_label, '(?i)inciso\\s+([ivxlcdm0-9]+)', 1)), ''), 'ali' || nullif(lower(regexp_extract(s.section_label, '(?i)al[ií]nea\\s+([a-z])', 1)), '')) AS signature,
  greatest(1, least(3, coalesce(nullif(s.relevance, 0), 1))) AS grade, coalesce(nullif(trim(s.grupo), ''), 'solo:' || pos) AS grp
  FROM (SELECT question_id, unnest(range(len(relevant_sources))) AS pos, unnest(relevant_sources) AS s FROM gt_questions))""".replace("\\\\", "\\"))
def expected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.expected_sources(table(spark, sf_dir, "gt_questions")).select("question_id", "pos", "signature", "grade", "grp")




@register("""WITH c AS (SELECT parent_chunk_id, max(chunk_index) AS score, arg_max(chunk_id, (chunk_index, chunk_id)) AS best, document_id FROM (
    SELECT DISTINCT chunk_id, parent_chunk_id, chunk_index, document_id FROM metadata WHERE chunk_strategy = 'hierarchical-child' AND parent_chunk_id IS NOT NULL)
  WHERE parent_chunk_id IN (SELECT chunk_id FROM metadata WHERE chunk_strategy = 'hierarchical') GROUP BY parent_chunk_id, document_id)
SELECT document_id AS query, parent_chunk_id, CAST(score AS DOUBLE) AS score FROM c""")
def parent_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children replaced by their parents; every document's children are one set of hits, scored by their index."""
    chunks = table(spark, sf_dir, "metadata")
    hits = chunks.where("chunk_strategy = 'hierarchical-child'").select(F.col("document_id").alias("query"), "chunk_id", "parent_chunk_id", F.col("chunk_index").cast("double").alias("score"), F.col("chunk_index").alias("rank")).distinct()
    return R.expand_to_parents(hits, chunks.where("chunk_strategy = 'hierarchical'")).select("query", "parent_chunk_id", "score")
