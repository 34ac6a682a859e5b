"""Queries that choose, union and patch rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import html as H
from tessitura.functions import text as T
from tessitura.functions.keys import loose_id
from tessitura.operators import ingest
from tessitura.operators.retrieval import of_named_module
from tessitura.plans.registry import register
from tessitura.schemas import IN_FORCE, METADATA_COLUMNS
from tessitura.session import table


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an order."""
    if n <= 0:
        raise ValueError("n must be positive")
    return df.orderBy(*order).limit(n)


@register("SELECT registro, id, titulo FROM corpus WHERE metodo_extracao = 'markdown' ORDER BY registro LIMIT 25")
def first_of_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_n(table(spark, sf_dir, "corpus").where("metodo_extracao = 'markdown'").select("registro", "id", "titulo"), 25, "registro")


@register("""SELECT DISTINCT chunk_id, chunk_index FROM metadata WHERE chunk_strategy = 'article-aware' AND metodo_extracao = 'texto' AND tipo = 'ato_normativo' ORDER BY chunk_id LIMIT 40""")
def first_of_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "metadata").where("chunk_strategy = 'article-aware' and metodo_extracao = 'texto' and tipo = 'ato_normativo'")
    return first_n(rows.select("chunk_id", "chunk_index").distinct(), 40, "chunk_id")


@register("""SELECT label, model, mode FROM store_configs WHERE chunk_strategy IN ('fixed-size', 'article-aware') AND metodo_extracao IN ('texto') AND NOT rerank ORDER BY label LIMIT 3""")
def first_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "store_configs").where("chunk_strategy in ('fixed-size', 'article-aware') and metodo_extracao in ('texto') and not rerank")
    return first_n(rows.select("label", "model", "mode"), 3, "label")


@register("SELECT " + ", ".join(METADATA_COLUMNS) + ", CAST(len(embedding) AS INT) AS dims FROM metadata")
def chunk_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata columns of every chunk, in their order, with the vector's length in place of the vector."""
    return table(spark, sf_dir, "metadata").select(*METADATA_COLUMNS, F.array_size("embedding").alias("dims"))


_FORMAT = "CASE WHEN regexp_matches({0}, '(?i)\\.pdf$') THEN 'pdf' WHEN regexp_matches({0}, '(?i)\\.docx?$') THEN 'docx' WHEN regexp_matches({0}, '(?i)\\.xlsx?$') THEN 'xlsx' WHEN regexp_matches({0}, '(?i)\\.html?$') THEN 'html' END"
_PLAIN = r"regexp_replace(coalesce(nullif(text, ''), titulo, ''), '^[\s\p{Z}\x{85}\x1c-\x1f]+|[\s\p{Z}\x{85}\x1c-\x1f]+$', '', 'g')"
_SLUG = "coalesce(nullif(substr(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'documento')"
_NAME = r"regexp_replace(string_split_regex(regexp_replace(url, '[?#].*$', ''), '[/\\]')[-1], '\.[A-Za-z0-9]{1,5}$', '')"


@register(f"""SELECT doc_id, {_SLUG.format(_NAME)} AS id, kind AS tipo, NULL::VARCHAR AS subtipo, titulo, source AS fonte, url AS url_original, {_FORMAT.format("regexp_replace(url, '[?#].*$', '')")} AS formato_original,
  md5({_PLAIN}) AS texto, CASE WHEN length({_PLAIN}) > 1000 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS qualidade FROM documents WHERE url IS NOT NULL""")
def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows built from a source's listing: ids from addresses, base text, quality, absent columns null."""
    d = table(spark, sf_dir, "documents").where("url is not null")
    text = T.plain_text(F.col("text"), F.col("titulo"))
    return d.select(
        "doc_id", T.path_id(F.col("url")).alias("id"), F.col("kind").alias("tipo"), F.lit(None).cast("string").alias("subtipo"), "titulo", F.col("source").alias("fonte"),
        F.col("url").alias("url_original"), H.file_format(F.col("url")).alias("formato_original"), F.md5(text).alias("texto"), H.html_quality(text).alias("qualidade"))


@register("""SELECT registro, titulo, subtipo FROM corpus WHERE coalesce(contains(lower(titulo), 'energia'), FALSE) OR coalesce(contains(lower(subtipo), 'prod'), FALSE) OR coalesce(contains(lower(titulo), 'tarifa'), FALSE)""")
def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c, part: F.coalesce(F.contains(F.lower(c), F.lit(part)), F.lit(False))
    return table(spark, sf_dir, "corpus").where(ingest.any_of(has("titulo", "energia"), has("subtipo", "prod"), has("titulo", "tarifa"))).select("registro", "titulo", "subtipo")


@register("""SELECT config, question_id, count(*) AS n FROM per_question WHERE doc_recall_at_k = 1 AND recall_at_k = 0 GROUP BY ALL""")
def wrong_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right document, wrong passage."""
    return table(spark, sf_dir, "per_question").where("doc_recall_at_k = 1 and recall_at_k = 0").groupBy("config", "question_id").agg(F.count("*").alias("n"))


_NAMED = r"SELECT DISTINCT lower(regexp_replace(s.document_id, '^\s+|\s+$', '', 'g')) AS id FROM (SELECT unnest(relevant_sources) AS s FROM gt_questions) WHERE s.document_id IS NOT NULL"


@register(f"""WITH named AS ({_NAMED}), held AS (SELECT lower(regexp_replace(id, '^\\s+|\\s+$', '', 'g')) AS id, count(*) AS n, count(DISTINCT metodo_extracao) AS methods FROM corpus WHERE id IS NOT NULL GROUP BY 1)
SELECT named.id, coalesce(n, 0) AS n, coalesce(methods, 0) AS methods, coalesce(methods, 0) = 2 AS complete FROM named LEFT JOIN held ON held.id = named.id""")
def target_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that expected sources name, with the rows and methods the corpus has of each: two make it complete."""
    named = table(spark, sf_dir, "gt_questions").select(F.explode("relevant_sources.document_id").alias("d")).where("d is not null").select(loose_id(F.col("d")).alias("id")).distinct()
    held = table(spark, sf_dir, "corpus").where("id is not null").groupBy(loose_id(F.col("id")).alias("id")).agg(F.count("*").alias("n"), F.countDistinct("metodo_extracao").alias("methods"))
    both = named.join(held, "id", "left").na.fill(0, ["n", "methods"])
    return both.select("id", "n", "methods", (F.col("methods") == 2).alias("complete"))


@register("""SELECT question_id, coalesce(difficulty, 'medium') AS difficulty, coalesce(p.answer, expected_answer) AS expected_answer, p.answer IS NOT NULL AS patched FROM gt_questions
LEFT JOIN (SELECT question_id AS qid, max(ground_truth.expected_answer) AS answer FROM gt_audit_passing_sample WHERE trim(ground_truth.expected_answer) <> '' GROUP BY 1) p
  ON p.qid = question_id AND (expected_answer IS NULL OR trim(expected_answer) = '')""")
def patched_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without an expected answer take the audited one; all others stay as they are."""
    q = table(spark, sf_dir, "gt_questions")
    patch = table(spark, sf_dir, "gt_audit_passing_sample").where("trim(ground_truth.expected_answer) <> ''").groupBy("question_id").agg(F.max("ground_truth.expected_answer").alias("answer"))
    blank = F.col("expected_answer").isNull() | (F.trim("expected_answer") == "")
    joined = q.join(patch, "question_id", "left").withColumn("answer", F.when(blank, F.col("answer")))
    return joined.select("question_id", F.coalesce("difficulty", F.lit("medium")).alias("difficulty"), F.coalesce("answer", "expected_answer").alias("expected_answer"), F.col("answer").isNotNull().alias("patched"))


@register("""SELECT 'failed' AS run, config, question_id, count(*) AS n FROM per_question WHERE NOT answer_usable GROUP BY ALL UNION ALL
SELECT 'no_document', config, question_id, count(*) FROM per_question WHERE doc_recall_at_k = 0 GROUP BY ALL""")
def labelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two selections of results united, each row labelled with the one it comes from."""
    rows = table(spark, sf_dir, "per_question")
    part = lambda label, cond: rows.where(cond).groupBy(F.lit(label).alias("run"), "config", "question_id").agg(F.count("*").alias("n"))
    return part("failed", "not answer_usable").unionByName(part("no_document", "doc_recall_at_k = 0"))


@register("""SELECT registro, id, part, CAST(row_number() OVER (ORDER BY part, registro) AS BIGINT) AS position FROM (
  SELECT registro, id, CASE WHEN coalesce(lower(trim(situacao)) IN ('vigente', 'consolidada'), FALSE) THEN 0 ELSE 1 END AS part FROM corpus)""")
def in_force_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in force, then the others, numbered through: positions come from the counts of range partitions."""
    rows = table(spark, sf_dir, "corpus").select("registro", "id", F.when(ingest.in_force(F.col("situacao"), IN_FORCE), 0).otherwise(1).alias("part"))
    return ingest.numbered(rows, "position", "part", "registro")


@register("""SELECT m.model, s.chunk_strategy, e.metodo_extracao, o.mode, r.rerank, c.label IS NOT NULL AS configured FROM (SELECT DISTINCT model FROM store_configs) m, (SELECT DISTINCT chunk_strategy FROM store_configs) s,
  (SELECT DISTINCT metodo_extracao FROM store_configs) e, (SELECT DISTINCT mode FROM store_configs) o, (SELECT DISTINCT rerank FROM store_configs) r
LEFT JOIN (SELECT model, chunk_strategy, metodo_extracao, mode, rerank, min(label) AS label FROM store_configs GROUP BY ALL) c
  ON c.model = m.model AND c.chunk_strategy = s.chunk_strategy AND c.metodo_extracao = e.metodo_extracao AND c.mode = o.mode AND c.rerank = r.rerank""")
def config_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of the dimensions' values (a few each, from one small row of lists), and whether it is configured."""
    dims = ("model", "chunk_strategy", "metodo_extracao", "mode", "rerank")
    c = table(spark, sf_dir, "store_configs")
    made = c.agg(*(F.collect_set(d).alias(d) for d in dims))
    for d in dims:
        made = made.withColumn(d, F.explode(d))
    known = c.groupBy(*dims).agg(F.min("label").alias("label"))
    return made.join(known, list(dims), "left").select(*dims, F.col("label").isNotNull().alias("configured"))


@register("SELECT registro, id, qualidade_extracao FROM corpus WHERE qualidade_extracao < 0.9 AND NOT isnan(qualidade_extracao) ORDER BY qualidade_extracao, registro LIMIT 15")
def low_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "corpus").where("qualidade_extracao < 0.9 and not isnan(qualidade_extracao)").select("registro", "id", "qualidade_extracao")
    return first_n(low, 15, "qualidade_extracao", "registro")


@register("""SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate >= TIMESTAMP '1998-01-01') GROUP BY ALL""")
def customers_without_late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    gone = table(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return gone.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@register(r"""SELECT question_id, regexp_extract(question, '(?i)subm[óo]dulo\s+(\d+)\.(\d+)([a-z]?)', 1) || '-' || regexp_extract(question, '(?i)subm[óo]dulo\s+(\d+)\.(\d+)([a-z]?)', 2)
  || lower(regexp_extract(question, '(?i)subm[óo]dulo\s+(\d+)\.(\d+)([a-z]?)', 3)) AS module FROM gt_questions WHERE regexp_matches(question, '(?i)subm[óo]dulo\s+\d+\.\d+')""")
def question_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submodule that a question names."""
    return table(spark, sf_dir, "gt_questions").select("question_id", T.query_module(F.col("question")).alias("module")).where("module is not null")


@register(r"""WITH d AS (SELECT DISTINCT lower(trim(id)) AS id FROM corpus WHERE id IS NOT NULL), m AS (SELECT DISTINCT regexp_extract(id, 'subm(\d+-\d+[a-z]?)-', 1) AS module FROM d WHERE regexp_matches(id, 'subm\d+-\d+[a-z]?-'))
SELECT module, count(*) AS documents FROM m JOIN d ON regexp_matches(id, '(subm|rede-)' || module || '([^0-9a-z]|$)') GROUP BY module""")
def module_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each submodule, by the boundary rule: 1-2 isn't 1-24."""
    documents = table(spark, sf_dir, "corpus").select(loose_id(F.col("id")).alias("document_id")).where("document_id is not null").distinct()
    modules = documents.select(T.module_key(F.col("document_id")).alias("module")).where("module is not null").distinct()
    asked = modules.select(F.col("module").alias("query"), F.concat(F.lit("submódulo "), F.replace("module", F.lit("-"), F.lit("."))).alias("question"))
    met = of_named_module(asked, documents.withColumn("chunk_id", F.col("document_id")))
    return met.groupBy(F.col("query").alias("module")).agg(F.count("*").alias("documents"))


@register("""SELECT rule, coalesce(n, 0) AS n FROM (VALUES ('child without parent id'), ('parent missing'), ('parent of another strategy'), ('parent known')) v(rule) LEFT JOIN (
  SELECT CASE WHEN c.chunk_strategy = 'hierarchical-child' AND coalesce(trim(c.parent_chunk_id), '') = '' THEN 'child without parent id'
    WHEN coalesce(trim(c.parent_chunk_id), '') <> '' AND p.chunk_id IS NULL THEN 'parent missing'
    WHEN c.chunk_strategy = 'hierarchical-child' AND p.chunk_strategy <> 'hierarchical' THEN 'parent of another strategy' WHEN p.chunk_id IS NOT NULL THEN 'parent known' END AS rule, count(*) AS n
  FROM (SELECT DISTINCT chunk_id, parent_chunk_id, chunk_strategy FROM metadata) c
  LEFT JOIN (SELECT chunk_id, min(chunk_strategy) AS chunk_strategy FROM metadata GROUP BY chunk_id) p ON p.chunk_id = c.parent_chunk_id GROUP BY 1) USING (rule)""")
def hierarchy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks meet or break each rule of the hierarchy."""
    chunks = table(spark, sf_dir, "metadata").select("chunk_id", "parent_chunk_id", "chunk_strategy").distinct()
    parents = chunks.groupBy(F.col("chunk_id").alias("parent")).agg(F.min("chunk_strategy").alias("parent_strategy"))
    named, child = F.coalesce(F.trim("parent_chunk_id"), F.lit("")) != "", F.col("chunk_strategy") == "hierarchical-child"
    rules = {
        "child without parent id": child & ~named, "parent missing": named & F.col("parent").isNull(),
        "parent of another strategy": child & (F.col("parent_strategy") != "hierarchical"), "parent known": F.col("parent").isNotNull() & ~(child & (F.col("parent_strategy") != "hierarchical")),
    }
    one = chunks.join(parents, F.col("parent_chunk_id") == F.col("parent"), "left").agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("n")) for r in rules))).alias("x")).select("x.*")
