"""Queries on evaluation results, audited answers and expected answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.operators import evaluation as E
from tessitura.operators.ordered import nearest_rank
from tessitura.plans.registry import register
from tessitura.session import table

_METRICS = ("recall_at_k", "doc_recall_at_k", "precision_at_k", "mrr_at_k", "ndcg_at_k")


# Rows that repeat a result entirely, or tie on both times, are aggregated the same way in both engines.
_RAW = "FROM per_question WHERE config IS NOT NULL AND question_id IS NOT NULL"


@register(f"""SELECT config, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)}, round(avg(latency_ms), 6) AS latency_avg,
  list_sort(list(latency_ms) FILTER (WHERE latency_ms IS NOT NULL))[CAST(round_even(0.95 * (count(latency_ms) - 1), 0) AS INT) + 1] AS latency_p95,
  round(avg(CAST(answer_usable AS INT)), 6) AS usable_rate, round(avg(faithfulness), 6) AS faithfulness {_RAW} GROUP BY config""")
def config_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "per_question").where("config is not null and question_id is not null")
    mean = lambda c: F.round(F.avg(c), 6)
    sums = rows.groupBy("config").agg(
        F.count("*").alias("n"), *(mean(m).alias(m) for m in _METRICS), mean("latency_ms").alias("latency_avg"),
        mean(F.col("answer_usable").cast("int")).alias("usable_rate"), mean("faithfulness").alias("faithfulness"))
    ranked = nearest_rank(rows, ("config",), "latency_ms").select("config", F.col("ranked").alias("latency_p95"))
    return sums.join(ranked, "config", "left").select("config", "n", *_METRICS, "latency_avg", "latency_p95", "usable_rate", "faithfulness")


@register("""SELECT event_type, count(*) AS n, list_sort(list(value))[CAST(round_even(0.95 * (count(value) - 1), 0) AS INT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rank(table(spark, sf_dir, "events"), ("event_type",), "value").withColumnRenamed("ranked", "p95")


@register("""SELECT config, coalesce(nullif(generator_status, ''), 'unknown') AS status, count(*) AS n FROM per_question GROUP BY ALL""")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "per_question").groupBy("config", E.histogram(F.col("generator_status")).alias("status")).agg(F.count("*").alias("n"))


_FAILURE = """CASE WHEN usable THEN 'usable' WHEN generator IS NOT NULL AND generator <> 'ok' THEN 'generator_failure'
  WHEN recall <= 0 AND doc_recall <= 0 THEN 'retrieval_document_failure' WHEN recall <= 0 AND doc_recall > 0 THEN 'retrieval_passage_failure'
  WHEN correctness IS NULL THEN 'llm_judge_missing' WHEN citation < 0.5 AND correctness < 0.8 THEN 'citation_and_answer_failure'
  WHEN citation < 0.5 THEN 'citation_failure' WHEN correctness < 0.8 THEN 'answer_quality_failure' ELSE 'unknown_failure' END"""
_FOCUS = "CASE failure " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.NEXT_FOCUS.items()) + " ELSE 'manual_review' END"


@register(f"""SELECT sample_id, usable, failure, {_FOCUS} AS focus FROM (SELECT *, {_FAILURE} AS failure FROM (
  SELECT sample_id, recall, doc_recall, citation, correctness, NULL::VARCHAR AS generator,
    coalesce(recall > 0 AND citation >= 0.5 AND correctness >= 0.8, FALSE) AS usable FROM (
  SELECT sample_id, metrics.recall_at_k AS recall, metrics.doc_recall_at_k AS doc_recall, metrics.citation_accuracy AS citation,
    metrics.answer_correctness_llm_judge AS correctness FROM gt_audit_passing_sample)))""")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda c: F.col(f"metrics.{c}")
    recall, doc, cite, right = m("recall_at_k"), m("doc_recall_at_k"), m("citation_accuracy"), m("answer_correctness_llm_judge")
    ok = E.usable(recall, cite, right)
    rows = table(spark, sf_dir, "gt_audit_passing_sample").select("sample_id", ok.alias("usable"), E.failure_type(ok, F.lit(None).cast("string"), recall, doc, cite, right).alias("failure"))
    return rows.select("sample_id", "usable", "failure", E.next_focus(F.col("failure")).alias("focus"))


@register(f"""SELECT config, failure, {_FOCUS} AS focus, count(*) AS n, count(DISTINCT question_id) AS questions FROM (
  SELECT config, question_id, coalesce(nullif(failure_type, ''), 'unknown') AS failure FROM per_question WHERE NOT coalesce(answer_usable, FALSE)) GROUP BY ALL""")
def failure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "per_question").where(~F.coalesce("answer_usable", F.lit(False))).withColumn("failure", E.histogram(F.col("failure_type")))
    return rows.groupBy("config", "failure", E.next_focus(F.col("failure")).alias("focus")).agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("questions"))


def _rerank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configuration with its reranked twin."""
    c = table(spark, sf_dir, "store_configs")
    a = c.where("not rerank").select("provider", "model", "chunk_strategy", "metodo_extracao", "mode", F.col("label").alias("before"))
    b = c.where("rerank").select("provider", "model", "chunk_strategy", "metodo_extracao", "mode", F.col("label").alias("after"))
    return a.join(b, ["provider", "model", "chunk_strategy", "metodo_extracao", "mode"]).select(F.concat_ws(" > ", "before", "after").alias("pair"), "before", "after")


_PAIRED = """WITH pairs AS (
  SELECT a.label || ' > ' || b.label AS pair, a.label AS before, b.label AS after FROM store_configs a JOIN store_configs b
    USING (provider, model, chunk_strategy, metodo_extracao, mode) WHERE NOT a.rerank AND b.rerank),
worst AS (SELECT config, question_id, bool_and(coalesce(answer_usable, FALSE)) AS ok, min(coalesce(nullif(failure_type, ''), 'unknown')) AS failure,
  min(doc_recall_at_k) AS doc_recall FROM per_question WHERE config IS NOT NULL AND question_id IS NOT NULL GROUP BY ALL),
paired AS (SELECT pair, a.question_id, a.ok AS ok_before, b.ok AS ok_after, a.failure AS failure_before, b.failure AS failure_after,
  a.doc_recall AS doc_before, b.doc_recall AS doc_after,
  CASE WHEN a.ok AND b.ok THEN 'stable_pass' WHEN b.ok THEN 'saved' WHEN a.ok THEN 'broken' WHEN a.failure = b.failure THEN 'stable_fail_same_type' ELSE 'stable_fail_changed_type' END AS bucket
  FROM pairs JOIN worst a ON a.config = pairs.before JOIN worst b ON b.config = pairs.after AND b.question_id = a.question_id)
"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated results of a question are judged by the worst of them."""
    rows = table(spark, sf_dir, "per_question").where("config is not null and question_id is not null")
    worst = rows.groupBy("config", "question_id").agg(
        F.bool_and(F.coalesce("answer_usable", F.lit(False))).alias("answer_usable"), F.min(E.histogram(F.col("failure_type"))).alias("failure_type"),
        F.min("doc_recall_at_k").alias("doc_recall_at_k"), F.min("recall_at_k").alias("recall_at_k"))
    return E.pair_results(worst, _rerank_pairs(spark, sf_dir))


@register(_PAIRED + "SELECT pair, question_id, bucket, failure_before, failure_after FROM paired")
def pairing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).select("pair", "question_id", "bucket", F.col("failure_type_before").alias("failure_before"), F.col("failure_type_after").alias("failure_after"))


@register(_PAIRED + """, sums AS (SELECT pair, count(*) AS questions, count(*) FILTER (WHERE bucket = 'saved') AS saved, count(*) FILTER (WHERE bucket = 'broken') AS broken,
  count(*) FILTER (WHERE bucket = 'stable_pass') AS stable_pass, count(*) FILTER (WHERE bucket = 'stable_fail_same_type') AS stable_fail_same_type,
  count(*) FILTER (WHERE bucket = 'stable_fail_changed_type') AS stable_fail_changed_type, round(avg(doc_after) - avg(doc_before), 6) AS doc_recall_change,
  count(*) FILTER (WHERE failure_after = 'retrieval_document_failure') - count(*) FILTER (WHERE failure_before = 'retrieval_document_failure') AS doc_failure_change FROM paired GROUP BY pair)
SELECT *, CASE WHEN saved >= 2 * broken AND coalesce(doc_recall_change >= -0.02, TRUE) THEN 'promote' ELSE 'keep' END AS verdict,
  concat_ws(',', CASE WHEN saved < 2 * broken THEN 'saved_below_twice_broken' END, CASE WHEN doc_recall_change < -0.02 THEN 'doc_recall_drop' END) AS reasons FROM sums""")
def pairing_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.verdicts(_paired(spark, sf_dir))


@register(_PAIRED + """SELECT pair, question_id, CASE WHEN a IS NULL THEN 'after' ELSE 'before' END AS side FROM (
  SELECT coalesce(x.pair, y.pair) AS pair, coalesce(x.question_id, y.question_id) AS question_id, x.question_id AS a, y.question_id AS b FROM
  (SELECT DISTINCT pair, question_id FROM pairs JOIN worst ON config = before) x FULL JOIN (SELECT DISTINCT pair, question_id FROM pairs JOIN worst ON config = after) y
  ON x.pair = y.pair AND x.question_id = y.question_id) WHERE a IS NULL OR b IS NULL""")
def pairing_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "per_question").where("config is not null and question_id is not null")
    return E.question_asymmetry(rows, _rerank_pairs(spark, sf_dir))


@register(_PAIRED + """SELECT pair, question_id, 'saved' AS change FROM paired WHERE ok_after AND NOT ok_before UNION ALL
SELECT pair, question_id, 'broken' FROM paired WHERE ok_before AND NOT ok_after""")
def saved_and_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).where("bucket in ('saved', 'broken')").select("pair", "question_id", F.col("bucket").alias("change"))


@register(f"""SELECT config, round(avg(doc_recall_at_k), 3) AS doc_recall, round(avg(ndcg_at_k), 3) AS ndcg, round(avg(latency_ms), 1) AS latency
{_RAW} GROUP BY config ORDER BY avg(doc_recall_at_k) DESC, avg(ndcg_at_k) DESC, config LIMIT 5""")
def best_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "per_question").where("config is not null and question_id is not null")
    means = rows.groupBy("config").agg(F.avg("doc_recall_at_k").alias("d"), F.avg("ndcg_at_k").alias("n"), F.avg("latency_ms").alias("l"))
    top = means.orderBy(F.desc("d"), F.desc("n"), "config").limit(5)
    return top.select("config", F.round("d", 3).alias("doc_recall"), F.round("n", 3).alias("ndcg"), F.round("l", 1).alias("latency"))


@register("""SELECT config, question_id, max(loaded_at) AS loaded_at, count(*) AS n, count(*) FILTER (WHERE loaded_at > recorded_at + INTERVAL 7 DAY) AS late
FROM per_question WHERE config IS NOT NULL AND question_id IS NOT NULL GROUP BY ALL""")
def checkpoint_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that a resumed run would use, and how often it was written."""
    rows = table(spark, sf_dir, "per_question")
    late = F.count_if(F.col("loaded_at") > F.col("recorded_at") + F.expr("INTERVAL 7 DAY"))
    counts = rows.groupBy("config", "question_id").agg(F.count("*").alias("n"), late.alias("late"))
    last = E.last_results(rows.select("config", "question_id", "recorded_at", "loaded_at")).select("config", "question_id", "loaded_at")
    return last.join(counts, ["config", "question_id"]).select("config", "question_id", "loaded_at", "n", "late")


@register("""SELECT label, concat_ws('|', model, chunk_strategy, metodo_extracao, mode, CASE WHEN rerank THEN 'rerank' END) AS made,
  greatest(coalesce(candidates_k_override, CASE WHEN rerank OR mode = 'hierarchical' OR exclude_revogadas OR exclude_superseded_versions OR restrict_to_query_submodulo THEN greatest(50, 50) ELSE 10 END), 10) AS pool FROM store_configs""")
def config_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessitura.operators.retrieval import pool_size_column

    c = table(spark, sf_dir, "store_configs")
    made = F.concat_ws("|", "model", "chunk_strategy", "metodo_extracao", "mode", F.when(F.col("rerank"), "rerank"))
    return c.select("label", made.alias("made"), pool_size_column(10).alias("pool"))


_TOKENS = lambda c: f"list_filter(string_split(trim(regexp_replace(strip_accents(replace(replace(lower({c}), 'º', 'o'), 'ª', 'a')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND NOT list_contains({[*T.STOP_WORDS]}, x) AND (length(x) >= 4 OR list_contains({[*T.SHORT_TERMS]}, x)))"


@register(f"""SELECT question_id, CAST(len({_TOKENS('question')}) AS INT) AS n_tokens, array_to_string({_TOKENS('question')}, ' ') AS tokens FROM gt_questions WHERE question IS NOT NULL""")
def informative_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.informative(F.col("question"))
    return table(spark, sf_dir, "gt_questions").where("question is not null").select("question_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register("""SELECT question_id, coalesce(nullif(answerability, ''), 'corpus_supported') AS answerability, coalesce(nullif(answerability, ''), 'corpus_supported') = 'corpus_supported' AS evaluable,
  CAST(coalesce(len(relevant_sources), 0) AS INT) AS n_sources FROM gt_questions""")
def evaluable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(T.or_null(F.col("answerability")), F.lit("corpus_supported"))
    n = F.coalesce(F.array_size("relevant_sources"), F.lit(0))
    return table(spark, sf_dir, "gt_questions").select("question_id", kind.alias("answerability"), (kind == "corpus_supported").alias("evaluable"), n.alias("n_sources"))


@register("""SELECT CAST(ground_truth.n_sources AS INT) AS n_sources, count(*) AS n, count(*) FILTER (WHERE metrics.doc_recall_at_k = 0) AS missed FROM gt_audit_passing_sample GROUP BY ALL""")
def sources_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gt_audit_passing_sample")
    return rows.groupBy(F.col("ground_truth.n_sources").alias("n_sources")).agg(F.count("*").alias("n"), F.count_if(F.col("metrics.doc_recall_at_k") == 0).alias("missed"))


@register("""SELECT sample_id, CASE WHEN len(list_distinct(c)) > 0 THEN len(list_intersect(list_distinct(c), [l])) / len(list_distinct(c)) ELSE 0 END AS precise,
  CASE WHEN len(c) > 0 AND contains(array_to_string(c, chr(10)), l) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recalled FROM (
  SELECT sample_id, coalesce(list_filter(system_output.citations, lambda x: x IS NOT NULL), []) AS c, ground_truth.citation_label AS l FROM gt_audit_passing_sample WHERE ground_truth.citation_label IS NOT NULL)""")
def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gt_audit_passing_sample").where("ground_truth.citation_label is not null")
    cited = F.array_compact(F.coalesce("system_output.citations", F.array().cast("array<string>")))
    expected = F.array("ground_truth.citation_label")
    return rows.select("sample_id", E.citation_precision(cited, expected).alias("precise"), E.citation_recall(cited, expected).alias("recalled"))


@register(r"""SELECT question_id, list_sort(list_distinct(list_concat(
  list_transform(regexp_extract_all(question, '(?i)(REN\s+[\d.]+/\d{4})', 1), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))),
  list_transform(regexp_extract_all(question, '(?i)(Lei\s+[\d.]+/\d{4})', 1), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g')))))) AS ids FROM gt_questions WHERE question IS NOT NULL""")
def question_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gt_questions").where("question is not null").select("question_id", F.sort_array(T.identifiers(F.col("question"))).alias("ids"))


_AUDIT = f"""WITH src AS (SELECT DISTINCT question_id, s.document_id AS document_id, s.support_excerpt AS excerpt
  FROM (SELECT question_id, unnest(relevant_sources) AS s FROM gt_questions) WHERE s.document_id IS NOT NULL AND s.support_excerpt IS NOT NULL),
docs AS (SELECT id, metodo_extracao, arg_max(texto, registro) AS texto FROM corpus WHERE texto IS NOT NULL GROUP BY ALL),
tok AS (SELECT question_id, src.document_id, excerpt, metodo_extracao, {_TOKENS('excerpt')} AS n, {_TOKENS('texto')} AS h,
  trim(regexp_replace(strip_accents(replace(replace(lower(excerpt), 'º', 'o'), 'ª', 'a')), '[^a-z0-9]+', ' ', 'g')) AS ne,
  trim(regexp_replace(strip_accents(replace(replace(lower(texto), 'º', 'o'), 'ª', 'a')), '[^a-z0-9]+', ' ', 'g')) AS nt
  FROM src JOIN docs ON docs.id = src.document_id),
cov AS (SELECT *, CASE WHEN len(n) = 0 THEN 0.0 ELSE len(list_filter(n, lambda x: list_contains(h, x))) / len(n) END AS c FROM tok)
"""


@register(_AUDIT + """SELECT question_id, document_id, metodo_extracao, md5(excerpt) AS excerpt, round(c, 6) AS coverage, CASE WHEN ne = '' THEN 'NOT_FOUND' WHEN contains(nt, ne) THEN 'LITERAL' WHEN c >= 0.6 THEN 'TOKEN'
  WHEN c >= 0.3 THEN 'LOW' ELSE 'NOT_FOUND' END AS class FROM cov""")
def excerpt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _excerpts(spark, sf_dir)
    return rows.select("question_id", "document_id", "metodo_extracao", F.md5("excerpt").alias("excerpt"), F.round("share", 6).alias("coverage"), "class")


#: Excerpts of a document that meet its text in one row.
EXCERPT_GROUP = 256


def _excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "gt_questions").select("question_id", F.explode("relevant_sources").alias("s"))
    source = source.select("question_id", F.col("s.document_id").alias("document_id"), F.col("s.support_excerpt").alias("excerpt")).where("document_id is not null and excerpt is not null").distinct()
    source = source.select("question_id", "document_id", "excerpt", T.normalized(F.col("excerpt")).alias("needle"), T.informative(F.col("excerpt")).alias("tokens"))
    docs = table(spark, sf_dir, "corpus").where("texto is not null").groupBy("id", "metodo_extracao").agg(F.max_by("texto", "registro").alias("texto"))
    # Only documents that a source names are tokenised, each once; a text goes to groups of excerpts, not to each of them.
    sizes = source.groupBy("document_id").agg(F.ceil(F.count("*") / EXCERPT_GROUP).alias("groups"))
    docs = docs.join(sizes.select(F.col("document_id").alias("id")), "id", "left_semi")
    docs = docs.select("id", "metodo_extracao", T.normalized(F.col("texto")).alias("flat"))
    grouped = source.join(sizes, "document_id").groupBy("document_id", F.pmod(F.xxhash64("question_id", "excerpt"), "groups").alias("group"))
    asked = grouped.agg(F.collect_list(F.struct("question_id", "excerpt", "needle", "tokens")).alias("asked"))

    def scored(d: Column) -> Column:
        shares = F.transform("asked", lambda x: F.struct(x.alias("x"), T.coverage(x["tokens"], d["words"], 0.0).alias("share")))
        return F.transform(shares, lambda y: F.struct(
            y["x"]["question_id"].alias("question_id"), y["x"]["excerpt"].alias("excerpt"), y["share"].alias("share"), T.excerpt_class(y["x"]["needle"], d["flat"], y["share"]).alias("class")))

    joined = asked.join(docs, F.col("document_id") == F.col("id"))
    # Bound by a lambda: a text is split once.
    found = F.transform(F.array(F.struct("flat", F.split("flat", " ").alias("words"))), scored)[0]
    return joined.select("document_id", "metodo_extracao", F.explode(found).alias("r")).select("document_id", "metodo_extracao", "r.*")


@register(_AUDIT + """SELECT threshold::DOUBLE AS threshold, count(DISTINCT question_id) AS questions, count(DISTINCT question_id) FILTER (WHERE c >= threshold) AS covered
FROM cov, (VALUES (0.5), (0.55), (0.6), (0.65), (0.7)) t(threshold) GROUP BY threshold""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _excerpts(spark, sf_dir).select("question_id", F.col("share").alias("c")).groupBy("question_id").agg(F.max("c").alias("c"))
    steps = F.explode(F.array(*(F.lit(x) for x in (0.5, 0.55, 0.6, 0.65, 0.7)))).alias("threshold")
    return best.select("question_id", "c", steps).groupBy("threshold").agg(F.countDistinct("question_id").alias("questions"), F.count_if(F.col("c") >= F.col("threshold")).alias("covered"))


@register("""SELECT rule, count(*) AS n FROM (
  SELECT unnest(list_filter([CASE WHEN question_id IS NULL OR NOT regexp_matches(question_id, '^gt-\\d{4,}$') THEN 'question_id' END, CASE WHEN question IS NULL OR trim(question) = '' THEN 'question' END,
   CASE WHEN expected_answer IS NULL OR trim(expected_answer) = '' THEN 'expected_answer' END, CASE WHEN query_type NOT IN ('factual', 'procedural', 'definition', 'comparison') THEN 'query_type' END,
   CASE WHEN difficulty NOT IN ('easy', 'medium', 'hard') THEN 'difficulty' END, CASE WHEN answerability NOT IN ('corpus_supported', 'source_only', 'not_in_corpus') THEN 'answerability' END, CASE WHEN coalesce(len(relevant_sources), 0) = 0 THEN 'no_sources' END], lambda x: x IS NOT NULL)) AS rule FROM gt_questions
  UNION ALL SELECT unnest(list_filter([CASE WHEN s.document_id IS NULL THEN 'source_without_document' END, CASE WHEN coalesce(s.relevance, 0) NOT BETWEEN 1 AND 3 THEN 'relevance' END,
   CASE WHEN s.url NOT LIKE 'http%' THEN 'url' END], lambda x: x IS NOT NULL)) FROM (SELECT unnest(relevant_sources) AS s FROM gt_questions)) GROUP BY rule""".replace("\\\\", "\\"))
def ground_truth_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessitura.schemas import ANSWERABILITIES, DIFFICULTIES, QUERY_TYPES

    q = table(spark, sf_dir, "gt_questions")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    row = [
        F.when(F.col("question_id").isNull() | ~F.col("question_id").rlike(r"^gt-\d{4,}$"), "question_id"), F.when(blank("question"), "question"), F.when(blank("expected_answer"), "expected_answer"),
        F.when(~F.col("query_type").isin(*QUERY_TYPES), "query_type"), F.when(~F.col("difficulty").isin(*DIFFICULTIES), "difficulty"), F.when(~F.col("answerability").isin(*ANSWERABILITIES), "answerability"),
        F.when(F.coalesce(F.array_size("relevant_sources"), F.lit(0)) == 0, "no_sources"),
    ]
    source = [
        F.when(F.col("s.document_id").isNull(), "source_without_document"), F.when(~F.coalesce("s.relevance", F.lit(0)).between(1, 3), "relevance"), F.when(~F.col("s.url").startswith("http"), "url"),
    ]
    errors = q.select(F.explode(F.array_compact(F.array(*row))).alias("rule"))
    errors = errors.unionByName(q.select(F.explode("relevant_sources").alias("s")).select(F.explode(F.array_compact(F.array(*source))).alias("rule")))
    return errors.groupBy("rule").agg(F.count("*").alias("n"))


ANSWER_LEAST, EXCERPT_LEAST = 0.55, 0.70


def _sequence_errors(q: DataFrame) -> DataFrame:
    """Ids must be gt-0001 to the number of rows: those of another form, repeats and gaps."""
    number = F.regexp_extract("question_id", r"^gt-(\d{4,})$", 1).try_cast("long")
    number = F.when((number > 0) & (F.concat(F.lit("gt-"), F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), F.lit("0"))) == F.col("question_id")), number)
    each = q.groupBy(number.alias("i")).agg(F.count("*").alias("n"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("i").isNotNull(), c)), F.lit(0))
    sums = each.agg(
        F.coalesce(F.sum(F.when(F.col("i").isNull(), F.col("n"))), F.lit(0)).alias("id_form"), of(F.col("n") - 1).alias("id_repeated"),
        (F.coalesce(F.max("i"), F.lit(0)) - F.count("i")).alias("id_gap"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in sums.columns))).alias("x")).select("x.*").where("n > 0")


def ground_truth_errors(q: DataFrame, corpus: DataFrame) -> DataFrame:
    """``rule, n``: the sequence of ids, answers that their source's excerpt
    doesn't support, and, of questions the corpus supports, sources it doesn't
    have and excerpts that its texts of the document don't cover."""
    kind = F.coalesce(T.or_null(F.col("answerability")), F.lit("corpus_supported"))
    s = q.select("expected_answer", kind.alias("kind"), F.explode("relevant_sources").alias("s"))
    s = s.select("expected_answer", "kind", F.col("s.document_id").alias("id"), F.coalesce("s.support_excerpt", F.lit("")).alias("excerpt"))
    answer = T.coverage(T.informative(F.coalesce("expected_answer", F.lit(""))), T.informative(F.col("excerpt")), 1.0)
    errors = s.where(answer < ANSWER_LEAST).agg(F.count("*").alias("n")).select(F.lit("answer_coverage").alias("rule"), "n")
    s = s.where("kind = 'corpus_supported' and id is not null").groupBy("id", "excerpt").agg(F.count("*").alias("sources"))
    known = corpus.select("id").distinct().join(s.select("id").distinct(), "id", "left_semi")
    unknown = s.join(known, "id", "left_anti").agg(F.coalesce(F.sum("sources"), F.lit(0)).alias("n"))
    errors = errors.unionByName(unknown.select(F.lit("source_not_in_corpus").alias("rule"), "n"))
    # Word by word, so that no document's texts are gathered.
    texts = corpus.join(known, "id", "left_semi").select("id", F.explode(F.array_distinct(T.informative(F.coalesce("texto", F.lit(""))))).alias("word")).distinct()
    needles = s.join(known, "id", "left_semi").select("id", "excerpt", "sources", F.explode(T.informative(F.col("excerpt"))).alias("word"))
    held = needles.join(texts.withColumn("held", F.lit(1)), ["id", "word"], "left")
    share = held.groupBy("id", "excerpt").agg(F.first("sources").alias("sources"), (F.count("held") / F.count("*")).alias("share"))
    low = share.where(F.col("share") < EXCERPT_LEAST).agg(F.coalesce(F.sum("sources"), F.lit(0)).alias("n"))
    errors = errors.unionByName(low.select(F.lit("excerpt_coverage").alias("rule"), "n")).where("n > 0")
    return _sequence_errors(q).unionByName(errors)


@register()
def ground_truth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground_truth_errors(table(spark, sf_dir, "gt_questions"), table(spark, sf_dir, "corpus"))


@register("""SELECT query_type, coalesce(difficulty, 'none') AS difficulty, count(*) AS questions, count(*) FILTER (WHERE coalesce(nullif(answerability, ''), 'corpus_supported') = 'corpus_supported') AS evaluable,
  count(DISTINCT expected_answer) AS answers FROM gt_questions GROUP BY ALL""")
def question_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(T.or_null(F.col("answerability")), F.lit("corpus_supported"))
    return table(spark, sf_dir, "gt_questions").groupBy("query_type", F.coalesce("difficulty", F.lit("none")).alias("difficulty")).agg(
        F.count("*").alias("questions"), F.count_if(kind == "corpus_supported").alias("evaluable"), F.countDistinct("expected_answer").alias("answers"))


_ANSWER_COVER = _TOKENS("ground_truth.expected_answer")


@register(f"""SELECT sample_id, CASE WHEN len(n) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(n, lambda x: list_contains(h, x))) / len(n), 6) END AS covered FROM (
  SELECT sample_id, {_ANSWER_COVER} AS n, {_TOKENS('system_output.generated_answer')} AS h FROM gt_audit_passing_sample
  WHERE ground_truth.expected_answer IS NOT NULL AND system_output.generated_answer IS NOT NULL)""")
def answer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the expected answer's informative words that the generated one has."""
    rows = table(spark, sf_dir, "gt_audit_passing_sample").where("ground_truth.expected_answer is not null and system_output.generated_answer is not null")
    share = T.coverage(T.informative(F.col("ground_truth.expected_answer")), T.informative(F.col("system_output.generated_answer")), 1.0)
    return rows.select("sample_id", F.round(share, 6).alias("covered"))


@register("""SELECT sample_id, coalesce(list_contains(list_filter(system_output.citations, lambda x: x IS NOT NULL), ground_truth.citation_label), FALSE)::DOUBLE AS hit FROM gt_audit_passing_sample""")
def citation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gt_audit_passing_sample")
    none = F.array().cast("array<string>")
    return rows.select("sample_id", E.article_hit(F.coalesce("system_output.citations", none), F.array("ground_truth.citation_label")).alias("hit"))
