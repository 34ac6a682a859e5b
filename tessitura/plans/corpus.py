"""Queries on the collected documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.functions.keys import strip
from tessitura.functions.times import parse_instant
from tessitura.operators import ingest
from tessitura.plans.registry import register, sql_utc
from tessitura.schemas import DOCUMENT_REQUIRED, IN_FORCE
from tessitura.session import table

_PARSED = f"coalesce({sql_utc('scraped_at')}, TIMESTAMP '0001-01-01')"
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}\x1c-\x1f]+|[\s\p{{Z}}\x{{85}}\x1c-\x1f]+$', '', 'g')"


@register(f"""SELECT registro, id, metodo_extracao, fonte FROM (
  SELECT *, row_number() OVER (PARTITION BY id, metodo_extracao ORDER BY {_PARSED} DESC, registro DESC) AS r FROM corpus) WHERE r = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "corpus").select("registro", "id", "metodo_extracao", "fonte", "scraped_at")
    # The later half of the rows comes in; both halves together are the whole table.
    middle = corpus.agg(F.avg("registro")).first()[0] or 0.0
    merged = ingest.upsert(corpus.where(F.col("registro") <= middle), corpus.where(F.col("registro") > middle))
    return merged.select("registro", "id", "metodo_extracao", "fonte")


@register(f"""SELECT registro, CAST(epoch_us({sql_utc('scraped_at')}) AS BIGINT) AS scraped_us,
  strftime({sql_utc('scraped_at')}, '%Y-%m-%dT%H:%M:%SZ') AS scraped_utc FROM corpus""")
def lenient_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = parse_instant(F.col("scraped_at"))
    utc = F.timestamp_seconds(F.unix_seconds(ts))
    return table(spark, sf_dir, "corpus").select("registro", F.unix_micros(ts).alias("scraped_us"), F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), utc.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("scraped_utc"))


@register("""SELECT id, m AS metodo_extracao FROM (SELECT DISTINCT id FROM corpus WHERE id IS NOT NULL), (VALUES ('texto'), ('markdown')) v(m)
EXCEPT SELECT id, metodo_extracao FROM corpus""")
def missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.missing_methods(table(spark, sf_dir, "corpus"))


@register(
    " UNION ALL ".join(f"SELECT 'null:{c}' AS rule, count(*) FILTER (WHERE {c} IS NULL) AS rows FROM corpus" for c in DOCUMENT_REQUIRED)
    + """ UNION ALL SELECT 'short:texto', count(*) FILTER (WHERE length(texto) < 100) FROM corpus
UNION ALL SELECT 'enum:metodo_extracao', count(*) FILTER (WHERE metodo_extracao NOT IN ('texto', 'markdown')) FROM corpus
UNION ALL SELECT 'duplicate:id+metodo', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM corpus GROUP BY id, metodo_extracao)"""
)
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.document_violations(table(spark, sf_dir, "corpus"))


@register(f"""SELECT doc_id, length(text) AS raw_chars, length({_STRIP.format('text')}) AS bare_chars,
  length(text) < 100 AS short_raw, length({_STRIP.format('text')}) < 100 AS short_bare FROM documents WHERE text IS NOT NULL""")
def short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, bare = F.length("text").cast("long"), F.length(strip(F.col("text"))).cast("long")
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", raw.alias("raw_chars"), bare.alias("bare_chars"), (raw < 100).alias("short_raw"), (bare < 100).alias("short_bare"))


@register("""SELECT fonte, coalesce(lower(trim(situacao)) IN ('vigente', 'consolidada'), FALSE) AS em_vigor, count(*) AS n FROM corpus GROUP BY ALL""")
def in_force_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus").groupBy("fonte", ingest.in_force(F.col("situacao"), IN_FORCE).alias("em_vigor")).agg(F.count("*").alias("n"))


@register("""SELECT id, arg_min(titulo, registro) AS titulo, count(*) AS n_rows,
  md5(coalesce(string_agg(texto, chr(10) ORDER BY registro), '')) AS digest FROM corpus GROUP BY id""")
def catalog_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.catalog(table(spark, sf_dir, "corpus"))
    return made.select("id", "titulo", "n_rows", F.md5("texto").alias("digest"))


@register("SELECT tipo, metodo_extracao, extrator, count(*) AS n, avg(qualidade_extracao) AS qualidade FROM corpus GROUP BY ALL")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus").groupBy("tipo", "metodo_extracao", "extrator").agg(F.count("*").alias("n"), F.avg("qualidade_extracao").alias("qualidade"))


@register("SELECT registro, id, qualidade_extracao FROM corpus WHERE qualidade_extracao < 0.5 ORDER BY qualidade_extracao, registro LIMIT 15")
def lowest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "corpus").where("qualidade_extracao < 0.5")
    return low.orderBy("qualidade_extracao", "registro").limit(15).select("registro", "id", "qualidade_extracao")


@register("""SELECT md5(text) AS digest, count(*) AS n, count(*) - 1 AS extras, min(doc_id) AS first_id FROM documents
WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1""")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(
        F.md5(F.first("text")).alias("digest"), F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return same.where("n > 1").select("digest", "n", (F.col("n") - 1).alias("extras"), "first_id")


_SLUG = "coalesce(nullif(substr(regexp_replace(regexp_replace(strip_accents(lower(titulo)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'documento')"


@register(f"""SELECT registro, slug, CASE WHEN r > 1 THEN slug || '-' || r ELSE slug END AS unique_id FROM (
  SELECT registro, slug, row_number() OVER (PARTITION BY slug ORDER BY registro) AS r FROM (SELECT registro, {_SLUG} AS slug FROM corpus))""")
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = table(spark, sf_dir, "corpus").select("registro", T.slug(F.col("titulo")).alias("slug"))
    return ingest.suffixed(slugs, "slug", "registro", "unique_id")


@register(r"""SELECT question_id, nullif(regexp_extract(question, '(?i)\b(REN|REH|DSP)\s+([\d.]+)/(\d{4})', 1), '') AS sigla,
  try_cast(replace(regexp_extract(question, '(?i)\b(REN|REH|DSP)\s+([\d.]+)/(\d{4})', 2), '.', '') AS INT) AS numero,
  try_cast(regexp_extract(question, '(?i)\b(REN|REH|DSP)\s+([\d.]+)/(\d{4})', 3) AS INT) AS ano FROM gt_questions""")
def resolution_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda g: F.regexp_extract("question", r"(?i)\b(REN|REH|DSP)\s+([\d.]+)/(\d{4})", g)
    return table(spark, sf_dir, "gt_questions").select(
        "question_id", T.or_null(part(1)).alias("sigla"), F.replace(part(2), F.lit("."), F.lit("")).try_cast("int").alias("numero"), part(3).try_cast("int").alias("ano"))


@register("""SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%d') AS day,
  try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of epoch milliseconds."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    day = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(millis).cast("timestamp_ntz")), "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select("event_id", day.alias("day"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))
