"""Diagnostic aggregates and gates of chunks, answers, sources and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions import text as T
from tessitura.functions.keys import loose_id
from tessitura.functions.times import month_of
from tessitura.operators.evaluation import status_accuracy
from tessitura.operators.retrieval import exact_top_k
from tessitura.plans.chunks import _followed, _placed
from tessitura.plans.evaluation import _PAIRED, _TOKENS, _paired
from tessitura.plans.registry import register
from tessitura.plans.retrieval import _LABEL, _SIGNATURE
from tessitura.schemas import METHODS, MIN_TEXT
from tessitura.session import materialize, table
from tessitura.sources.tables import store_violations

#: Characters that an embedding request holds of a text, for a limit of tokens.
TOKEN_LIMIT, CHARS_PER_TOKEN = 512, 3


@register(f"""SELECT source, count(*) AS n, count(*) FILTER (WHERE ceil(length(text) / {CHARS_PER_TOKEN}.0) > {TOKEN_LIMIT}) AS truncated,
  CAST(max(ceil(length(text) / {CHARS_PER_TOKEN}.0)) AS BIGINT) AS most_tokens FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def truncation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.ceil(F.length("text") / CHARS_PER_TOKEN)
    rows = table(spark, sf_dir, "documents").where("text is not null").select("source", tokens.alias("t"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("t") > TOKEN_LIMIT).alias("truncated"), F.max("t").alias("most_tokens"))


_LOOSE = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
_EXCERPTS = f"""ex AS (SELECT DISTINCT question_id, {_LOOSE.format('s.document_id')} AS document_id, s.support_excerpt AS excerpt FROM (SELECT question_id, unnest(relevant_sources) AS s FROM gt_questions)
  WHERE s.document_id IS NOT NULL AND trim(s.support_excerpt) <> '')"""


def _excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "gt_questions").select("question_id", F.explode("relevant_sources").alias("s"))
    s = s.where("s.document_id is not null and trim(s.support_excerpt) <> ''")
    return s.select("question_id", loose_id(F.col("s.document_id")).alias("document_id"), F.col("s.support_excerpt").alias("excerpt")).distinct()


@register(f"""WITH {_EXCERPTS}, ch AS (SELECT chunk_id, {_LOOSE.format('document_id')} AS document_id, texto FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, texto) AS r FROM metadata) WHERE r = 1 AND texto IS NOT NULL),
cov AS (SELECT question_id, ex.document_id, excerpt, chunk_id, {_TOKENS('excerpt')} AS n, {_TOKENS('texto')} AS h FROM ex JOIN ch ON ch.document_id = ex.document_id),
best AS (SELECT *, CASE WHEN len(n) = 0 THEN 0.0 ELSE len(list_filter(n, lambda x: list_contains(h, x))) / len(n) END AS c FROM cov)
SELECT question_id, document_id, md5(excerpt) AS excerpt, chunk_id, round(c, 6) AS coverage FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id, document_id, excerpt ORDER BY c DESC, chunk_id) AS r FROM best) WHERE r = 1""")
def best_covering_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each expected excerpt the chunk of its document that covers most of it, the first one on ties."""
    chunks = _placed(spark, sf_dir).where("texto is not null").select("chunk_id", loose_id(F.col("document_id")).alias("document_id"), T.informative(F.col("texto")).alias("h"))
    joined = _excerpts(spark, sf_dir).withColumn("n", T.informative(F.col("excerpt"))).join(chunks, "document_id")
    share = joined.select("question_id", "document_id", "excerpt", "chunk_id", T.coverage(F.col("n"), F.col("h"), 0.0).alias("c"))
    best = share.groupBy("question_id", "document_id", "excerpt").agg(F.max("c").alias("top"), F.min_by("chunk_id", F.struct(-F.col("c"), "chunk_id")).alias("chunk_id"))
    return best.select("question_id", "document_id", F.md5("excerpt").alias("excerpt"), "chunk_id", F.round("top", 6).alias("coverage"))


_FLATTEN = "trim(regexp_replace(strip_accents(replace(replace(lower({}), 'º', 'o'), 'ª', 'a')), '[^a-z0-9]+', ' ', 'g'))"


@register(f"""WITH {_EXCERPTS}, ch AS (SELECT chunk_id, document_id, metodo_extracao, chunk_strategy, chunk_index, texto FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, texto) AS r FROM metadata) WHERE r = 1),
nx AS (SELECT *, lead(chunk_index) OVER w AS i2, lead(texto) OVER w AS t2, lead(chunk_index, 2) OVER w AS i3, lead(texto, 2) OVER w AS t3 FROM ch
  WINDOW w AS (PARTITION BY document_id, metodo_extracao, chunk_strategy ORDER BY chunk_index, chunk_id)),
joined AS (SELECT {_LOOSE.format('document_id')} AS document_id, {_FLATTEN.format('texto')} AS one,
  CASE WHEN i2 = chunk_index + 1 THEN {_FLATTEN.format("texto || ' ' || coalesce(t2, '')")} END AS two,
  CASE WHEN i2 = chunk_index + 1 AND i3 = chunk_index + 2 THEN {_FLATTEN.format("texto || ' ' || coalesce(t2, '') || ' ' || coalesce(t3, '')")} END AS three FROM nx)
SELECT question_id, ex.document_id, md5(excerpt) AS excerpt,
  CAST(min(CASE WHEN contains(one, e) THEN 1 WHEN contains(two, e) THEN 2 WHEN contains(three, e) THEN 3 END) AS INT) AS chunks
FROM (SELECT *, {_FLATTEN.format('excerpt')} AS e FROM ex) ex JOIN joined ON joined.document_id = ex.document_id WHERE e <> '' GROUP BY ALL""")
def excerpt_in_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many adjacent chunks (1, 2 or 3) of a document an excerpt is found whole; null if in none."""
    rows = _placed(spark, sf_dir)
    two = materialize(_followed(rows).select(*rows.columns, "next_id", "next_text"), "followed")
    ahead = two.select(F.col("chunk_id").alias("a_id"), F.col("next_id").alias("third_id"), F.col("next_text").alias("third_text"))
    # The chunk after the next one: the follower of the next, where that is the last of its place.
    three = two.join(ahead, F.col("next_id") == F.col("a_id"), "left")
    flat = lambda *c: T.normalized(F.concat_ws(" ", *c))
    texts = three.select(
        loose_id(F.col("document_id")).alias("document_id"), T.normalized(F.col("texto")).alias("one"),
        F.when(F.col("next_id").isNotNull() & F.col("texto").isNotNull(), flat("texto", "next_text")).alias("two"),
        F.when(F.col("third_id").isNotNull() & F.col("texto").isNotNull(), flat("texto", "next_text", "third_text")).alias("three"))
    asked = _excerpts(spark, sf_dir).withColumn("e", T.normalized(F.col("excerpt"))).where("e <> ''")
    n = F.when(F.contains("one", F.col("e")), 1).when(F.contains("two", F.col("e")), 2).when(F.contains("three", F.col("e")), 3)
    return asked.join(texts, "document_id").groupBy("question_id", "document_id", "excerpt").agg(F.min(n).alias("chunks")).withColumn("excerpt", F.md5("excerpt"))


@register("""SELECT run_id, count(*) FILTER (WHERE v = 'right') AS right_, count(*) FILTER (WHERE v = 'partly') AS partly, count(*) FILTER (WHERE v = 'wrong') AS wrong, count(*) FILTER (WHERE v = 'unknown') AS unknown,
  round(count(*) FILTER (WHERE v = 'right') / nullif(count(*) FILTER (WHERE v <> 'unknown'), 0), 6) AS strict_precision,
  round(count(*) FILTER (WHERE v IN ('right', 'partly')) / nullif(count(*) FILTER (WHERE v <> 'unknown'), 0), 6) AS tolerant_precision FROM (
  SELECT run_id, CASE WHEN c IS NULL OR isnan(c) THEN 'unknown' WHEN c >= 0.8 THEN 'right' WHEN c >= 0.5 THEN 'partly' ELSE 'wrong' END AS v FROM (
    SELECT run_id, metrics.answer_correctness_llm_judge AS c FROM gt_audit_passing_sample)) GROUP BY run_id""")
def judge_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the judge per run, and its precision with and without partly right answers."""
    c = T.finite(F.col("metrics.answer_correctness_llm_judge"))
    v = F.when(c.isNull(), "unknown").when(c >= 0.8, "right").when(c >= 0.5, "partly").otherwise("wrong")
    rows = table(spark, sf_dir, "gt_audit_passing_sample").select("run_id", v.alias("v"))
    n = lambda *vs: F.count_if(F.col("v").isin(*vs))
    judged = F.nullif(n("right", "partly", "wrong"), F.lit(0))
    return rows.groupBy("run_id").agg(
        n("right").alias("right_"), n("partly").alias("partly"), n("wrong").alias("wrong"), n("unknown").alias("unknown"),
        F.round(n("right") / judged, 6).alias("strict_precision"), F.round(n("right", "partly") / judged, 6).alias("tolerant_precision"))


@register(_PAIRED + """SELECT metodo_extracao, count(*) FILTER (WHERE NOT ok_before) AS failed_before, count(*) FILTER (WHERE NOT ok_after) AS failed_after,
  round((count(*) FILTER (WHERE NOT ok_before) - count(*) FILTER (WHERE NOT ok_after)) / nullif(count(*) FILTER (WHERE NOT ok_before), 0), 6) AS reduction, count(*) FILTER (WHERE ok_before AND NOT ok_after) AS regressions
FROM paired JOIN (SELECT label, metodo_extracao FROM store_configs) c ON paired.pair LIKE c.label || ' > %' GROUP BY metodo_extracao""")
def relative_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer failures after a change, relative to before, per extraction method, and how many questions got worse."""
    configs = table(spark, sf_dir, "store_configs").select(F.col("label").alias("before"), "metodo_extracao")
    p = _paired(spark, sf_dir).withColumn("before", F.split("pair", " > ", 2)[0]).join(configs, "before")
    b, a = F.count_if(~F.col("answer_usable_before")), F.count_if(~F.col("answer_usable_after"))
    return p.groupBy("metodo_extracao").agg(
        b.alias("failed_before"), a.alias("failed_after"), F.round((b - a) / F.nullif(b, F.lit(0)), 6).alias("reduction"), F.count_if(F.col("answer_usable_before") & ~F.col("answer_usable_after")).alias("regressions"))


@register("""WITH src AS (SELECT question_id, unnest(range(len(relevant_sources))) AS pos, unnest(relevant_sources) AS s FROM gt_questions),
g AS (SELECT question_id, nullif(trim(s.grupo), '') AS grupo, pos FROM src),
firsts AS (SELECT question_id, coalesce(grupo, 'solo:' || pos) AS grp, grupo IS NULL AS solo, min(pos) AS first FROM g GROUP BY ALL)
SELECT question_id, grp, CAST(row_number() OVER (PARTITION BY question_id ORDER BY solo, first) AS INT) AS position FROM firsts""")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named groups of sources by their first appearance, then single sources."""
    g = table(spark, sf_dir, "gt_questions").select("question_id", F.posexplode("relevant_sources").alias("pos", "s"))
    named = T.or_null(F.trim("s.grupo"))
    firsts = g.groupBy("question_id", F.coalesce(named, F.concat(F.lit("solo:"), F.col("pos").cast("string"))).alias("grp"), named.isNull().alias("solo")).agg(F.min("pos").alias("first"))
    return firsts.select("question_id", "grp", F.row_number().over(Window.partitionBy("question_id").orderBy("solo", "first")).alias("position"))


@register(r"""SELECT sample_id, i AS cited, c[i] AS label FROM (
  SELECT sample_id, c, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(system_output.generated_answer, '\[(\d{1,9})\]', 1), lambda x: CAST(x AS INT)), lambda x: x >= 1 AND x <= len(c)))) AS i FROM (
    SELECT *, coalesce(system_output.citations, []) AS c FROM gt_audit_passing_sample))""")
def cited_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that an answer cites by number: numbers out of range and repeats fall out."""
    rows = table(spark, sf_dir, "gt_audit_passing_sample").select("sample_id", F.col("system_output.generated_answer").alias("a"), F.coalesce("system_output.citations", F.array().cast("array<string>")).alias("c"))
    cited = rows.select("sample_id", "c", F.explode(T.cited_indices(F.col("a"), F.size("c"))).alias("cited"))
    return cited.select("sample_id", "cited", F.try_element_at("c", F.col("cited")).alias("label"))


@register(r"""SELECT sample_id, md5(coalesce(system_output.generated_answer, '') || chr(10) || chr(10) || '| # | fonte |' || chr(10) || '|---|---|' ||
  array_to_string(list_transform(range(1, len(c) + 1), lambda i: chr(10) || '| ' || i || ' | ' || replace(coalesce(c[i], ''), '|', '\|') || ' |'), '')) AS digest, CAST(len(c) AS INT) AS sources FROM (
  SELECT *, coalesce(system_output.citations, []) AS c FROM gt_audit_passing_sample)""")
def answer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with its sources as a Markdown table, as a digest."""
    rows = table(spark, sf_dir, "gt_audit_passing_sample").select("sample_id", F.coalesce("system_output.generated_answer", F.lit("")).alias("a"), F.coalesce("system_output.citations", F.array().cast("array<string>")).alias("c"))
    line = lambda x, i: F.concat(F.lit("\n| "), (i + 1).cast("string"), F.lit(" | "), F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit(" |"))
    made = F.concat("a", F.lit("\n\n| # | fonte |\n|---|---|"), F.array_join(F.transform("c", line), ""))
    return rows.select("sample_id", F.md5(made).alias("digest"), F.size("c").alias("sources"))


@register("""SELECT fonte, count(*) AS n, count(*) FILTER (WHERE isfinite(qualidade_extracao)) AS known, round(avg(qualidade_extracao) FILTER (WHERE isfinite(qualidade_extracao)), 6) AS quality FROM corpus GROUP BY ALL""")
def finite_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "corpus").select("fonte", T.finite(F.col("qualidade_extracao")).alias("q"))
    return rows.groupBy("fonte").agg(F.count("*").alias("n"), F.count("q").alias("known"), F.round(F.avg("q"), 6).alias("quality"))


@register(r"""WITH ids AS (SELECT question_id, unnest(list_distinct(list_concat(
  list_transform(regexp_extract_all(question, '(?i)(REN\s+[\d.]+/\d{4})', 1), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))),
  list_transform(regexp_extract_all(question, '(?i)(Lei\s+[\d.]+/\d{4})', 1), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))),
  list_transform(regexp_extract_all(question, '(?i)(Despacho\s+[\d.]+/\d{4})', 1), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g')))))) AS id FROM gt_questions)
SELECT question_id, id, regexp_extract(id, '^(ren|lei|despacho) ([\d.]+)/(\d{4})', 1) AS sigla, try_cast(replace(regexp_extract(id, '^(ren|lei|despacho) ([\d.]+)/(\d{4})', 2), '.', '') AS INT) AS numero,
  try_cast(regexp_extract(id, '^(ren|lei|despacho) ([\d.]+)/(\d{4})', 3) AS INT) AS ano FROM ids WHERE regexp_matches(id, '^(ren|lei|despacho) ([\d.]+)/(\d{4})')""")
def identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the acts that questions name, from the start of each identifier."""
    ids = table(spark, sf_dir, "gt_questions").select("question_id", F.explode(T.identifiers(F.col("question"))).alias("id"))
    part = lambda g: F.regexp_extract("id", r"^(ren|lei|despacho) ([\d.]+)/(\d{4})", g)
    return ids.select("question_id", "id", part(1).alias("sigla"), F.replace(part(2), F.lit("."), F.lit("")).try_cast("int").alias("numero"), part(3).try_cast("int").alias("ano")).where("sigla <> ''")


@register("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE json_extract(props, '$.k') IS NOT NULL) AS forbidden FROM events GROUP BY ALL""")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nested JSON values hold a key that must not be there, at any depth."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.coalesce(has_key("props", "k"), F.lit(False))).alias("forbidden"))


def has_key(json_col: str, *keys: str):
    """Whether a JSON text has one of the keys at any depth; keys inside strings are escaped and don't count."""
    return F.col(json_col).rlike(r'(?<!\\)"(?:' + "|".join(keys) + r')"\s*:')


@register(f"""SELECT 'duplicate_key' AS rule, count(*) AS n FROM (SELECT id, metodo_extracao FROM corpus GROUP BY ALL HAVING count(*) > 1) UNION ALL
SELECT 'one_method', count(*) FROM (SELECT id FROM corpus WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT metodo_extracao) = 1) UNION ALL
SELECT 'short_text', count(*) FROM corpus WHERE length(regexp_replace(coalesce(texto, ''), '^[\\s\\p{{Z}}\\x{{85}}\\x1c-\\x1f]+|[\\s\\p{{Z}}\\x{{85}}\\x1c-\\x1f]+$', '', 'g')) < {MIN_TEXT}""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys, ids with one method only and short texts of the corpus."""
    c = table(spark, sf_dir, "corpus")
    repeated = c.groupBy("id", "metodo_extracao").count().where("count > 1").agg(F.count("*").alias("n"))
    single = c.where("id is not null").groupBy("id").agg(F.collect_set("metodo_extracao").alias("m")).where(F.size(F.array_intersect("m", F.array(*map(F.lit, METHODS)))) == 1).agg(F.count("*").alias("n"))
    short = c.agg(F.count_if(F.length(T.plain_text(F.lit(None).cast("string"), F.col("texto"))) < MIN_TEXT).alias("n"))
    rows = [df.select(F.lit(rule).alias("rule"), "n") for rule, df in (("duplicate_key", repeated), ("one_method", single), ("short_text", short))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register(r"""SELECT model, count(*) AS n, count(*) FILTER (WHERE chunk_id IS NULL) AS no_id, count(*) FILTER (WHERE texto IS NULL OR regexp_replace(texto, '[\s\p{Z}\x{85}\x1c-\x1f]+', '', 'g') = '') AS blank,
  count(*) FILTER (WHERE embedding IS NULL) AS no_vector, count(*) FILTER (WHERE len(embedding) <> try_cast(regexp_extract(model, '(\d+)$', 1) AS INT)) AS wrong_length, CAST(ceil(count(*) / 256.0) AS BIGINT) AS batches
FROM metadata GROUP BY ALL""")
def index_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps chunks from being embedded or indexed, per model, and the batches they make."""
    m = table(spark, sf_dir, "metadata")
    wanted = F.regexp_extract("model", r"(\d+)$", 1).try_cast("int")
    return m.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("chunk_id").isNull()).alias("no_id"), F.count_if(F.size(T.words(F.coalesce("texto", F.lit("")))) == 0).alias("blank"),
        F.count_if(F.col("embedding").isNull()).alias("no_vector"), F.count_if(F.array_size("embedding") != wanted).alias("wrong_length"), F.ceil(F.count("*") / 256).alias("batches"))


_STORE = "provider, model, chunk_strategy, metodo_extracao"


@register(rf"""WITH s AS (SELECT {_STORE}, count(*) FILTER (WHERE chunk_id IS NULL) AS null_id, count(*) FILTER (WHERE regexp_replace(coalesce(texto, ''), '[\s\p{{Z}}\x{{85}}\x1c-\x1f]+', '', 'g') = '') AS blank_text,
  count(*) FILTER (WHERE embedding IS NULL) AS no_vector, count(*) FILTER (WHERE len(embedding) <> try_cast(regexp_extract(model, '(\d+)$', 1) AS INT)) AS dimension,
  count(*) FILTER (WHERE chunk_strategy = 'hierarchical-child' AND trim(coalesce(parent_chunk_id, '')) = '') AS child_without_parent, count(DISTINCT len(embedding)) - 1 AS mixed_dimension FROM metadata GROUP BY ALL),
r AS (SELECT {_STORE}, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT {_STORE}, chunk_id, count(*) AS n FROM metadata WHERE chunk_id IS NOT NULL GROUP BY ALL) GROUP BY {_STORE}),
u AS (SELECT {_STORE}, count(*) AS n FROM metadata WHERE chunk_strategy = 'hierarchical-child' AND trim(coalesce(parent_chunk_id, '')) <> ''
  AND trim(parent_chunk_id) NOT IN (SELECT chunk_id FROM metadata WHERE chunk_strategy = 'hierarchical' AND chunk_id IS NOT NULL) GROUP BY ALL)
SELECT * FROM (""" + " UNION ALL ".join(f"SELECT {_STORE}, '{r}' AS rule, CAST({r} AS BIGINT) AS n FROM s" for r in ("null_id", "blank_text", "no_vector", "dimension", "child_without_parent", "mixed_dimension"))
    + f" UNION ALL SELECT {_STORE}, 'repeated_id', n FROM r UNION ALL SELECT {_STORE}, 'unknown_parent', n FROM u) WHERE n > 0")
def store_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes the stores of the table unfit to be published."""
    return store_violations(table(spark, sf_dir, "metadata"))


@register("""SELECT coalesce(nullif(answerability, ''), 'corpus_supported') AS answerability, count(DISTINCT question_id) AS questions, count(DISTINCT lower(trim(s.document_id))) AS documents FROM (
  SELECT question_id, answerability, unnest(CASE WHEN len(relevant_sources) > 0 THEN relevant_sources ELSE [NULL] END) AS s FROM gt_questions) GROUP BY 1""")
def answerability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(T.or_null(F.col("answerability")), F.lit("corpus_supported")).alias("answerability")
    rows = table(spark, sf_dir, "gt_questions").select("question_id", kind, F.explode_outer("relevant_sources.document_id").alias("d"))
    # Counted by first occurrences, so that no distinct set is gathered.
    each = rows.select("answerability", F.lit("q").alias("of"), F.col("question_id").alias("v")).unionByName(rows.select("answerability", F.lit("d").alias("of"), F.lower(F.trim("d")).alias("v"))).where("v is not null").distinct()
    return each.groupBy("answerability").agg(F.count_if(F.col("of") == "q").alias("questions"), F.count_if(F.col("of") == "d").alias("documents"))


@register("""SELECT config, round(avg(ndcg_at_k), 4) AS ndcg, round(avg(mrr_at_k), 4) AS mrr FROM per_question WHERE config IS NOT NULL AND NOT isnan(ndcg_at_k) GROUP BY config ORDER BY avg(ndcg_at_k) DESC, config LIMIT 5""")
def best_by_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "per_question").where("config is not null and not isnan(ndcg_at_k)")
    means = rows.groupBy("config").agg(F.avg("ndcg_at_k").alias("n"), F.avg("mrr_at_k").alias("m")).orderBy(F.desc("n"), "config").limit(5)
    return means.select("config", F.round("n", 4).alias("ndcg"), F.round("m", 4).alias("mrr"))


@register("""WITH st AS (SELECT lower(trim(document_id)) AS d, strftime(indexed_at, '%Y-%m') AS month, list(situacao) FILTER (WHERE situacao IS NOT NULL) AS held FROM metadata WHERE document_id IS NOT NULL GROUP BY ALL)
SELECT d AS document_id, month, CASE WHEN coalesce(len(held), 0) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(held, lambda x: lower(x) = 'vigente')) / len(held), 6) END AS accuracy FROM st""")
def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a document's contexts of a month that have the expected status."""
    rows = table(spark, sf_dir, "metadata").where("document_id is not null").select(loose_id(F.col("document_id")).alias("document_id"), month_of(F.col("indexed_at")).alias("month"), "situacao")
    counts = rows.groupBy("document_id", "month").agg(F.count("situacao").alias("n"), F.count_if(F.lower("situacao") == "vigente").alias("m"))
    share = F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.col("m") / F.col("n"), 6))
    return counts.select("document_id", "month", share.alias("accuracy"))


@register("""WITH s AS (SELECT sample_id, CASE WHEN coalesce(trim(ground_truth.citation_label), '') = '' THEN 0.0::DOUBLE WHEN coalesce(len(c), 0) = 0 THEN 0.0::DOUBLE
  ELSE len(list_filter(c, lambda x: lower(x) = lower(ground_truth.citation_label))) / len(c) END AS share FROM (SELECT *, list_filter(system_output.citations, lambda x: x IS NOT NULL) AS c FROM gt_audit_passing_sample))
SELECT sample_id, round(share, 6) AS share FROM s""")
def citation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an answer's citations that are the expected one, whatever their case."""
    rows = table(spark, sf_dir, "gt_audit_passing_sample")
    label = F.when(F.trim("ground_truth.citation_label") != "", F.col("ground_truth.citation_label"))
    cited = F.array_compact(F.coalesce("system_output.citations", F.array().cast("array<string>")))
    return rows.select("sample_id", F.round(status_accuracy(cited, label), 6).alias("share"))


@register(f"""WITH a AS (SELECT question_id, unnest(list_sort(list_distinct({_TOKENS('question')}), 'DESC')[1:2]) AS anchor FROM gt_questions WHERE question IS NOT NULL),
n AS (SELECT question_id, count(*) AS n FROM a GROUP BY 1), t AS (SELECT DISTINCT chunk_id, unnest({_TOKENS('texto')}) AS anchor FROM metadata WHERE texto IS NOT NULL AND chunk_id IS NOT NULL)
SELECT question_id, count(*) AS chunks FROM (SELECT a.question_id, chunk_id FROM a JOIN t USING (anchor) JOIN n ON n.question_id = a.question_id GROUP BY a.question_id, chunk_id, n.n HAVING count(*) = n.n) GROUP BY 1""")
def chunks_with_all_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold every anchor of a question (its last two informative
    words by the alphabet; those of all its rows, should its id repeat). Chunks
    are counted per pair of asked words that they hold, whatever the number of
    questions; only questions of more than two anchors meet chunks."""
    words = F.slice(F.sort_array(F.array_distinct(T.informative(F.col("question"))), asc=False), 1, 2)
    asked = table(spark, sf_dir, "gt_questions").where("question is not null and question_id is not null").select("question_id", F.explode(words).alias("anchor"))
    anchors = materialize(asked.select("anchor").distinct().select("anchor", F.monotonically_increasing_id().alias("id")), "anchors")
    sets = asked.join(anchors, "anchor").groupBy("question_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    held = table(spark, sf_dir, "metadata").where("texto is not null and chunk_id is not null").select("chunk_id", F.explode(F.array_distinct(T.informative(F.col("texto")))).alias("anchor"))
    leads = held.join(anchors, "anchor").groupBy("chunk_id").agg(F.collect_set("id").alias("held")).select("held", F.explode("held").alias("lead"))
    # A single anchor is a pair with itself.
    pairs = leads.select("lead", F.explode("held").alias("last")).where("lead <= last").groupBy("lead", "last").agg(F.count("*").alias("chunks"))
    found = sets.where("size(ids) <= 2").select("question_id", F.col("ids")[0].alias("lead"), F.element_at("ids", -1).alias("last")).join(pairs, ["lead", "last"]).select("question_id", "chunks")
    more = sets.where("size(ids) > 2").select("question_id", "ids", F.col("ids")[0].alias("lead"))
    if more.isEmpty():
        return found
    # Only of ids that repeat.
    met = leads.join(more, "lead").where(F.forall("ids", lambda x: F.array_contains("held", x)))
    return found.unionByName(met.groupBy("question_id").agg(F.count("*").alias("chunks")))


@register(f"""WITH ex AS (SELECT DISTINCT question_id, {_LOOSE.format('s.document_id')} AS document_id, {_LABEL} AS sig, s.support_excerpt AS excerpt FROM (SELECT question_id, unnest(relevant_sources) AS s FROM gt_questions)
  WHERE s.document_id IS NOT NULL AND trim(s.support_excerpt) <> ''),
ch AS (SELECT DISTINCT chunk_id, {_LOOSE.format('document_id')} AS document_id, {_SIGNATURE} AS csig, {_TOKENS('texto')} AS h FROM metadata WHERE texto IS NOT NULL AND chunk_id IS NOT NULL),
cov AS (SELECT question_id, excerpt, sig, csig, chunk_id, {_TOKENS('excerpt')} AS n, h FROM ex JOIN ch ON ch.document_id = ex.document_id)
SELECT question_id, count(*) AS pairs, count(DISTINCT chunk_id) AS chunks FROM cov WHERE len(n) > 0 AND len(list_filter(n, lambda x: list_contains(h, x))) / len(n) >= 0.3 AND len(list_filter(n, lambda x: list_contains(h, x))) / len(n) < 0.6
  AND NOT (sig <> '' AND csig <> '' AND (sig = csig OR starts_with(sig, csig || '.') OR starts_with(csig, sig || '.'))) GROUP BY question_id""")
def marginal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts and chunks of their document that share 0.30 to 0.60 of the words and no section."""
    s = table(spark, sf_dir, "gt_questions").select("question_id", F.explode("relevant_sources").alias("s")).where("s.document_id is not null and trim(s.support_excerpt) <> ''")
    ex = s.select("question_id", loose_id(F.col("s.document_id")).alias("document_id"), T.label_signature(F.col("s.section_label")).alias("sig"), F.col("s.support_excerpt").alias("excerpt")).distinct()
    ex = ex.select("question_id", "document_id", "sig", T.informative(F.col("excerpt")).alias("n"))
    rows = table(spark, sf_dir, "metadata").where("texto is not null and chunk_id is not null")
    signature = T.chunk_signature(*(F.col(c) for c in ("artigo", "paragrafo", "inciso", "alinea"))).alias("csig")
    ch = rows.select("chunk_id", loose_id(F.col("document_id")).alias("document_id"), signature, T.informative(F.col("texto")).alias("h")).distinct()
    share = T.coverage(F.col("n"), F.col("h"), 0.0)
    met = ex.join(ch, "document_id").withColumn("c", share).where((F.col("c") >= 0.3) & (F.col("c") < 0.6) & ~T.signatures_match(F.col("csig"), F.col("sig")))
    return met.groupBy("question_id").agg(F.count("*").alias("pairs"), F.countDistinct("chunk_id").alias("chunks"))


@register("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL)
SELECT q.label, max(round(list_cosine_similarity(q.e, i.e), 9)) AS nearest FROM v q JOIN v i ON i.label = q.label AND i.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.label""")
def label_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label the largest cosine of a query (ids divisible by 100) and another vector of its label."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null").select(F.col("vec_id").cast("long").alias("item"), F.col("label").cast("string").alias("part"), F.col("embedding").alias("vector"), "label")
    near = exact_top_k(e.where("item % 100 = 0").withColumnRenamed("item", "query"), e, 1)
    names = e.select("part", "label").distinct()
    return near.groupBy("part").agg(F.max("score").alias("nearest")).join(names, "part").select("label", "nearest")
