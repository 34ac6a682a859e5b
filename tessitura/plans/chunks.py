"""Queries on chunks: made from texts, and those of the vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions import text as T
from tessitura.functions.keys import loose_id
from tessitura.operators import chunking
from tessitura.operators.ingest import latest_of_few
from tessitura.operators.ordered import ordered_digest
from tessitura.plans.registry import register
from tessitura.schemas import CHUNK_REQUIRED, STRATEGIES
from tessitura.session import materialize, table

_SPACES = r"[\s\p{Z}\x{85}\x1c-\x1f]+"
_WORDS = f"list_filter(string_split_regex(text, '{_SPACES}'), lambda x: x <> '')"
_STRIPPED = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}\x1c-\x1f]+|[\s\p{{Z}}\x{{85}}\x1c-\x1f]+$', '', 'g')"


def _windows(source: str, key: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""w AS (SELECT {key}, {_WORDS} AS w FROM ({source})),
s AS (SELECT {key}, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(w) - {size}) / {step}.0) AS INT) + 1) END)) AS i FROM w),
chunks AS (SELECT {key}, CAST(i AS INT) AS chunk_index, w[i * {step} + 1 : i * {step} + {size}] AS part FROM s)"""


@register("WITH " + _windows("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", "doc_id", 512, 64)
    + " SELECT doc_id, chunk_index, CAST(len(part) AS INT) AS n_words, md5(array_to_string(part, ' ')) AS digest FROM chunks")
def fixed_size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.fixed_size_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("doc_id", "chunk_index", F.size(T.words(F.col("texto"))).alias("n_words"), F.md5("texto").alias("digest"))


_W = r"[\s\p{Z}\x{85}\x1c-\x1f]*"
_SQL_ARTICLE = rf"(?im)^{_W}(?:#{{1,6}}{_W})?(?:\*\*)?{_W}((?:Art\.?|Artigo){_W}\d+[º°o]?(?:-[A-Z])?)"
_SQL_SECTION = r"(?im)^[\s\p{Z}]*((?:T[IÍ]TULO|CAP[IÍ]TULO|SE[CÇ][AÃ]O|M[ÓO]DULO|SUBM[ÓO]DULO)[\s\p{Z}]+[^\n]+)"


@register(rf"""WITH parts AS (
  SELECT registro, string_split(regexp_replace(texto, '{_SQL_ARTICLE}', chr(1) || '\0', 'g'), chr(1)) AS p FROM corpus WHERE texto IS NOT NULL),
each AS (SELECT registro, unnest(p) AS part, unnest(range(len(p))) AS position FROM parts),
titled AS (SELECT *, regexp_extract_all(part, '{_SQL_SECTION}', 1) AS titles FROM each),
named AS (SELECT registro, position, part,
  last_value(CASE WHEN len(titles) > 0 THEN trim(regexp_replace(titles[-1], '{_SPACES}', ' ', 'g')) END IGNORE NULLS) OVER (
    PARTITION BY registro ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS secao FROM titled)
SELECT registro, CAST(position AS INT) AS position, trim(regexp_replace(regexp_extract(part, '{_SQL_ARTICLE}', 1), '{_SPACES}', ' ', 'g')) AS artigo, secao,
  md5({_STRIPPED.format('part')}) AS digest FROM named WHERE position > 0""")
def article_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.article_segments(table(spark, sf_dir, "corpus"), "registro", "texto")
    return made.select("registro", "position", "artigo", "secao", F.md5("segment").alias("digest"))


@register()
def article_aware_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.article_aware_chunks(table(spark, sf_dir, "corpus"), "registro", "texto")


@register()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.article_aware_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@register()
def parent_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parent_child_chunks(table(spark, sf_dir, "corpus"), "registro", "texto")


@register("SELECT chunk_strategy, metodo_extracao, tipo, count(*) AS n FROM metadata GROUP BY ALL")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "metadata").groupBy("chunk_strategy", "metodo_extracao", "tipo").agg(F.count("*").alias("n"))


@register(r"""SELECT DISTINCT lower(regexp_replace(document_id, '^\s+|\s+$', '', 'g')) AS document_id, metodo_extracao FROM metadata
WHERE document_id IS NOT NULL AND metodo_extracao IS NOT NULL AND (lower(regexp_replace(document_id, '^\s+|\s+$', '', 'g')), metodo_extracao) NOT IN (
  SELECT (lower(regexp_replace(id, '^\s+|\s+$', '', 'g')), metodo_extracao) FROM corpus WHERE id IS NOT NULL AND metodo_extracao IS NOT NULL)""")
def chunks_without_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: [loose_id(F.col(c)).alias("document_id"), "metodo_extracao"]
    chunks = table(spark, sf_dir, "metadata").where("document_id is not null and metodo_extracao is not null").select(*key("document_id")).distinct()
    return chunks.join(table(spark, sf_dir, "corpus").select(*key("id")).distinct(), ["document_id", "metodo_extracao"], "left_anti")


@register("""SELECT problem, count(*) AS n FROM (
  SELECT c.chunk_id, CASE WHEN c.chunk_strategy = 'hierarchical-child' AND coalesce(trim(c.parent_chunk_id), '') = '' THEN 'child without parent id'
    WHEN coalesce(trim(c.parent_chunk_id), '') <> '' AND p.chunk_id IS NULL THEN 'parent missing'
    WHEN c.chunk_strategy = 'hierarchical-child' AND p.chunk_strategy <> 'hierarchical' THEN 'parent of another strategy' END AS problem
  FROM (SELECT DISTINCT chunk_id, parent_chunk_id, chunk_strategy FROM metadata) c
  LEFT JOIN (SELECT chunk_id, min(chunk_strategy) AS chunk_strategy FROM metadata GROUP BY chunk_id) p ON p.chunk_id = c.parent_chunk_id)
WHERE problem IS NOT NULL GROUP BY problem""")
def hierarchy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "metadata").select("chunk_id", "parent_chunk_id", "chunk_strategy").distinct()
    parents = chunks.groupBy(F.col("chunk_id").alias("parent")).agg(F.min("chunk_strategy").alias("parent_strategy"))
    named = F.coalesce(F.trim("parent_chunk_id"), F.lit("")) != ""
    child = F.col("chunk_strategy") == "hierarchical-child"
    problem = (
        F.when(child & ~named, "child without parent id").when(named & F.col("parent").isNull(), "parent missing")
        .when(child & (F.col("parent_strategy") != "hierarchical"), "parent of another strategy")
    )
    joined = chunks.join(parents, F.col("parent_chunk_id") == F.col("parent"), "left").withColumn("problem", problem)
    return joined.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


_STRATEGY_LIST = ", ".join(f"'{s}'" for s in STRATEGIES)


@register(
    " UNION ALL ".join(f"SELECT 'null:{c}' AS rule, count(*) FILTER (WHERE {c} IS NULL) AS rows FROM metadata" for c in CHUNK_REQUIRED)
    + f""" UNION ALL SELECT 'blank:texto', count(*) FILTER (WHERE {_STRIPPED.format('texto')} = '') FROM metadata
UNION ALL SELECT 'enum:chunk_strategy', count(*) FILTER (WHERE chunk_strategy NOT IN ({_STRATEGY_LIST})) FROM metadata
UNION ALL SELECT 'duplicate:chunk_id', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM metadata GROUP BY chunk_id)""")
def chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "metadata")
    rules = [(f"null:{c}", F.col(c).isNull()) for c in CHUNK_REQUIRED]
    rules += [("blank:texto", F.size(T.words(F.col("texto"))) == 0), ("enum:chunk_strategy", ~F.col("chunk_strategy").isin(*STRATEGIES))]
    one = chunks.agg(*(F.count_if(c).alias(n) for n, c in rules))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("rows")) for n, _ in rules))).alias("r")).select("r.*")
    extra = chunks.groupBy("chunk_id").count().agg(F.sum(F.col("count") - 1).alias("rows")).select(F.lit("duplicate:chunk_id").alias("rule"), "rows")
    return rows.unionByName(extra)


@register(f"""SELECT chunk_strategy, metodo_extracao, count(*) AS n, min(w) AS least, CAST(floor(quantile_cont(w, 0.5)) AS INT) AS p50,
  CAST(floor(quantile_cont(w, 0.95)) AS INT) AS p95, CAST(floor(quantile_cont(w, 0.99)) AS INT) AS p99, max(w) AS most,
  count(*) FILTER (WHERE w < 10) AS tiny, count(*) FILTER (WHERE w < 30) AS small, round(count(*) FILTER (WHERE w < 30) / count(*), 4) AS small_share, count(*) FILTER (WHERE w > 6000) AS huge
FROM (SELECT chunk_strategy, metodo_extracao, CAST(len({_WORDS}) AS INT) AS w FROM (SELECT chunk_strategy, metodo_extracao, texto AS text FROM metadata WHERE texto IS NOT NULL)) GROUP BY ALL""")
def chunk_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "metadata").where("texto is not null").select("chunk_strategy", "metodo_extracao", F.size(T.words(F.col("texto"))).alias("w"))
    q = lambda p: F.floor(F.percentile("w", F.lit(p))).cast("int")
    return rows.groupBy("chunk_strategy", "metodo_extracao").agg(
        F.count("*").alias("n"), F.min("w").alias("least"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max("w").alias("most"),
        F.count_if(F.col("w") < 10).alias("tiny"), F.count_if(F.col("w") < 30).alias("small"), F.round(F.count_if(F.col("w") < 30) / F.count("*"), 4).alias("small_share"), F.count_if(F.col("w") > 6000).alias("huge"))


_NOISE = "CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches(t, '{p}')" for p in patterns) + f" THEN '{label}'" for label, patterns in T.NOISE) + " ELSE 'outro' END"


@register(f"""SELECT {_NOISE} AS noise, count(*) AS n, CAST(min(len(string_split(t, ' '))) AS INT) AS least_words FROM (
  SELECT array_to_string({_WORDS}, ' ') AS t FROM (SELECT unnest(string_split(texto, chr(10))) AS text FROM corpus WHERE texto IS NOT NULL)) WHERE t <> '' GROUP BY ALL""")
def noise_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "corpus").select(F.explode(F.split("texto", "\n", -1)).alias("line"))
    lines = lines.select(T.collapse(F.col("line")).alias("t")).where("t <> ''")
    return lines.groupBy(T.noise_class(F.col("t")).alias("noise")).agg(F.count("*").alias("n"), F.min(F.size(F.split("t", " "))).alias("least_words"))


@register(f"""SELECT chunk_id, CAST(len({_WORDS}) AS INT) AS n_words, coalesce(try_cast(string_split(chunk_id, '::')[-1] AS INT), -1) AS parsed_index
FROM (SELECT DISTINCT chunk_id, texto AS text FROM metadata WHERE texto IS NOT NULL) ORDER BY n_words, chunk_id LIMIT 5""")
def smallest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "metadata").where("texto is not null")
    # Of the text only its size and hash go through the shuffle.
    sized = rows.select("chunk_id", F.size(T.words(F.col("texto"))).alias("n_words"), T.index_of_chunk(F.col("chunk_id")).alias("parsed_index"), F.xxhash64("texto").alias("h")).distinct()
    return sized.orderBy("n_words", "chunk_id").limit(5).drop("h")


@register("""SELECT chunk_id, concat_ws(', ', coalesce(nullif(titulo, ''), document_id), nullif(artigo, ''), nullif(paragrafo, ''),
    'inciso ' || nullif(inciso, ''), 'alinea ' || nullif(alinea, ''))
  || CASE WHEN coalesce(nullif(artigo, ''), nullif(paragrafo, ''), nullif(inciso, ''), nullif(alinea, '')) IS NULL THEN ', chunk ' || chunk_index ELSE '' END AS label
FROM (SELECT DISTINCT chunk_id, titulo, document_id, artigo, paragrafo, inciso, alinea, chunk_index FROM metadata)""")
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("titulo", "document_id", "artigo", "paragrafo", "inciso", "alinea", "chunk_index")
    rows = table(spark, sf_dir, "metadata").select("chunk_id", *fields).distinct()
    return rows.select("chunk_id", T.citation_label(*(F.col(c) for c in fields)).alias("label"))


@register("""SELECT provider, model, chunk_strategy, metodo_extracao, count(*) AS n, list_sort(list_distinct(list(tipo) FILTER (WHERE tipo IS NOT NULL))) AS tipos,
  count(DISTINCT document_id) AS documents FROM metadata GROUP BY ALL""")
def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "metadata").groupBy("provider", "model", "chunk_strategy", "metodo_extracao").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("tipo")).alias("tipos"), F.countDistinct("document_id").alias("documents"))


@register("""SELECT document_id, metodo_extracao, chunk_strategy, count(*) AS n, substr(sha256(string_agg(chunk_id || chr(10), '' ORDER BY chunk_id)), 1, 16) AS digest
FROM (SELECT DISTINCT document_id, metodo_extracao, chunk_strategy, chunk_id FROM metadata) GROUP BY ALL""")
def ordered_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("document_id", "metodo_extracao", "chunk_strategy")
    made = ordered_digest(table(spark, sf_dir, "metadata"), keys, "chunk_id")
    return made.select(*keys, "n", F.substring("digest", 1, 16).alias("digest"))


@register("""SELECT chunk_id, CASE WHEN lead(chunk_index) OVER w = chunk_index + 1 THEN lead(chunk_id) OVER w END AS next_id,
  md5(texto || CASE WHEN lead(chunk_index) OVER w = chunk_index + 1 THEN ' ' || coalesce(lead(texto) OVER w, '') ELSE '' END) AS digest
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, texto) AS r FROM metadata) WHERE r = 1)
WINDOW w AS (PARTITION BY document_id, metodo_extracao, chunk_strategy ORDER BY chunk_index, chunk_id)""")
def adjacent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir)
    joined = _followed(rows)
    both = F.concat("texto", F.when(F.col("next_id").isNotNull(), F.concat(F.lit(" "), F.coalesce("next_text", F.lit("")))).otherwise(""))
    return joined.select("chunk_id", "next_id", F.md5(both).alias("digest"))


_PLACE = ("document_id", "metodo_extracao", "chunk_strategy")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk once, as it was indexed last, with its place; first and last of the chunks at its place are marked."""
    rows = table(spark, sf_dir, "metadata").select("chunk_id", *_PLACE, "chunk_index", "texto", "indexed_at")
    rows = latest_of_few(rows, "chunk_id", F.desc("indexed_at"), F.asc("texto")).drop("indexed_at")
    same = Window.partitionBy(*_PLACE, "chunk_index")  # copies of one place, not a whole document
    rows = rows.withColumn("is_first", F.col("chunk_id") == F.min("chunk_id").over(same)).withColumn("is_last", F.col("chunk_id") == F.max("chunk_id").over(same))
    return materialize(rows, "placed")


def _followed(rows: DataFrame) -> DataFrame:
    """``rows`` with the chunk at the next index of their document: an equi-join on the place, so a large document is spread."""
    after = rows.where("is_first").select(*(F.col(c).alias(f"_{c}") for c in _PLACE), (F.col("chunk_index") - 1).alias("_index"), F.col("chunk_id").alias("next_id"), F.col("texto").alias("next_text"))
    same = F.col("is_last") & (F.col("chunk_index") == F.col("_index"))
    for c in _PLACE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(after, same, "left")
