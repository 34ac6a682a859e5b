"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import answers, encoding, endings, near_duplicates, packing, repeated_lines, vectors
from tessitura.session import table

_SIDES = {"generated": "system_output.generated_answer", "expected": "ground_truth.expected_answer"}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = answers.learn_words(table(spark, sf_dir, "documents"), "text", "lang")
    return answers.find_defects(table(spark, sf_dir, "gt_audit_passing_sample"), "sample_id", "question", _SIDES, words)


_CORPUS = ("registro", "id", "fonte", "texto")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines.find_repeated_lines(table(spark, sf_dir, "corpus"), *_CORPUS)
    return found.withColumnRenamed("line_no", "linha_no")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.remove_repeated_lines(table(spark, sf_dir, "corpus"), *_CORPUS)


def p2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.find_repeated_blocks(table(spark, sf_dir, "corpus"), *_CORPUS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "corpus"), "id", "texto")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "corpus"), "id", "texto")


_CHUNKS = ("chunk_id", "model", "embedding", "indexed_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vectors.similar_pairs(table(spark, sf_dir, "metadata"), *_CHUNKS)
    return pairs.withColumnsRenamed({"item_a": "chunk_id_a", "item_b": "chunk_id_b"})


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_report(p7_containers(spark, sf_dir))


_TEXTS = ("doc_id", "text", "lang")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endings.find_cut_texts(table(spark, sf_dir, "documents"), *_TEXTS, "source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endings.cut_shares(table(spark, sf_dir, "documents"), *_TEXTS, "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_clean, p2_blocks, p3_found, p3_groups, p5_found, p6_ids, p7_containers, p7_report, p8_found, p8_shares)}


_LINES = r"""
WITH parts AS (SELECT registro, id, fonte, string_split(texto, chr(10)) AS parts FROM corpus WHERE texto IS NOT NULL AND fonte IS NOT NULL),
split AS (SELECT registro, id, fonte, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS linha_no FROM parts),
keyed AS (SELECT registro, id, fonte, linha_no, line, lower(regexp_replace(line, '\P{L}+', '', 'g')) AS k FROM split),
totals AS (SELECT fonte, count(DISTINCT id) AS n FROM corpus GROUP BY fonte),
cases AS (
  SELECT keyed.fonte, k FROM keyed JOIN totals ON totals.fonte = keyed.fonte WHERE length(k) >= 15
  GROUP BY keyed.fonte, k, n HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.05 * n),
gone AS (SELECT registro, linha_no FROM keyed JOIN cases ON cases.fonte = keyed.fonte AND cases.k = keyed.k)
"""


_BLOCKS = r"""
, eligible AS (SELECT registro, id, fonte, list(k ORDER BY linha_no) AS ks FROM keyed WHERE length(k) >= 15 GROUP BY ALL),
starts AS (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM eligible),
parts2 AS (SELECT *, unnest(range(i, least(i + 16, len(ks) + 1))) AS j FROM starts),
blocks AS (SELECT p.fonte, p.ks[i : j] AS block, count(DISTINCT id) AS docs, count(*) AS places, n FROM parts2 p JOIN totals ON totals.fonte = p.fonte
  GROUP BY ALL HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.05 * n),
held AS (SELECT DISTINCT fonte, places, unnest([block[1 : len(block) - 1], block[2 : len(block)]]) AS part FROM blocks WHERE len(block) > 1)
SELECT fonte AS source, CAST(len(block) AS INT) AS n_lines, docs, places, n AS source_docs FROM blocks
WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.fonte = blocks.fonte AND held.part = blocks.block AND held.places = blocks.places)"""


_GROUPS = r"""
WITH RECURSIVE words AS (SELECT DISTINCT id, regexp_extract_all(lower(texto), '[\p{L}\p{N}]+') AS w FROM corpus WHERE id IS NOT NULL AND texto IS NOT NULL),
cls AS (SELECT w, row_number() OVER (ORDER BY w) AS t FROM (SELECT DISTINCT w FROM words WHERE len(w) >= 3)),
mem AS (SELECT DISTINCT id, t FROM words JOIN cls USING (w)),
runs AS (SELECT DISTINCT t, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT t, w, unnest(range(1, len(w) - 1)) AS i FROM cls)),
sizes AS (SELECT t, count(*) AS n FROM runs GROUP BY t),
shared AS (SELECT x.t AS a, y.t AS b, count(*) AS n FROM runs x JOIN runs y ON x.run = y.run AND x.t < y.t GROUP BY ALL),
owners AS (SELECT t, min(id) AS low, max(id) AS high FROM mem GROUP BY t),
links AS (SELECT a, b FROM shared JOIN sizes sa ON sa.t = a JOIN sizes sb ON sb.t = b JOIN owners p ON p.t = a JOIN owners q ON q.t = b
  WHERE shared.n >= 0.5 * (sa.n + sb.n - shared.n) AND NOT (p.low = p.high AND q.low = q.high AND p.low = q.low)),
degree AS (SELECT t, count(*) AS n FROM (SELECT a AS t FROM links UNION ALL SELECT b FROM links) GROUP BY t),
edges AS (SELECT DISTINCT p.id AS x, q.id AS y FROM links JOIN mem p ON p.t = a JOIN mem q ON q.t = b UNION SELECT p.id, q.id FROM mem p JOIN mem q ON p.t = q.t),
twoway AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT DISTINCT id, id AS other FROM words UNION SELECT reach.id, twoway.y FROM reach JOIN twoway ON twoway.x = reach.other)
SELECT r.id, r.group_id, CAST(coalesce(l.n, 0) AS BIGINT) AS links FROM (SELECT id, min(other) AS group_id FROM reach GROUP BY id) r
LEFT JOIN (SELECT id, sum(n) AS n FROM mem JOIN degree USING (t) GROUP BY id) l ON l.id = r.id"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_groups": _GROUPS,
        # Blocks of up to 16 lines; these tables have none longer.
        "p2_blocks": _LINES + _BLOCKS,
        "p3_found": r"""
WITH words AS (SELECT DISTINCT id, regexp_extract_all(lower(texto), '[\p{L}\p{N}]+') AS w FROM corpus WHERE id IS NOT NULL AND texto IS NOT NULL),
texts AS (SELECT row_number() OVER (ORDER BY id, w) AS t, id, w FROM words WHERE len(w) >= 3),
runs AS (SELECT DISTINCT t, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT t, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
sizes AS (SELECT t, count(*) AS n FROM runs GROUP BY t),
shared AS (SELECT x.t AS a, y.t AS b, count(*) AS n FROM runs x JOIN runs y ON x.run = y.run AND x.t < y.t GROUP BY ALL)
SELECT DISTINCT least(p.id, q.id) AS id_a, greatest(p.id, q.id) AS id_b
FROM shared JOIN sizes sa ON sa.t = a JOIN sizes sb ON sb.t = b JOIN texts p ON p.t = a JOIN texts q ON q.t = b
WHERE p.id <> q.id AND shared.n >= 0.5 * (sa.n + sb.n - shared.n)""",
        "p5_found": r"""
WITH usable AS (
  SELECT chunk_id, model, arg_max(e, indexed_at) AS e FROM (
    SELECT chunk_id, model, indexed_at, embedding::DOUBLE[] AS e, try_cast(regexp_extract(model, '(\d+)$', 1) AS INT) AS dim
    FROM metadata WHERE embedding IS NOT NULL AND chunk_id IS NOT NULL)
  WHERE len(e) = dim AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
  GROUP BY chunk_id, model),
scored AS (
  SELECT x.chunk_id AS a, y.chunk_id AS b,
    row_number() OVER (PARTITION BY x.model, x.chunk_id ORDER BY round(list_cosine_similarity(x.e, y.e), 12) DESC, y.chunk_id) AS r
  FROM usable x JOIN usable y ON x.model = y.model AND x.chunk_id <> y.chunk_id)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM scored WHERE r <= 5""",
        "p2_found": _LINES + "SELECT registro, linha_no FROM gone",
        "p2_clean": _LINES
        + """SELECT c.registro,
  CASE WHEN n.removed IS NULL THEN c.texto ELSE coalesce(k.text, '') END AS text, coalesce(n.removed, 0) AS removed
FROM corpus c
LEFT JOIN (SELECT registro, count(*) AS removed FROM gone GROUP BY registro) n ON n.registro = c.registro
LEFT JOIN (SELECT s.registro, string_agg(s.line, chr(10) ORDER BY s.linha_no) AS text FROM split s
  LEFT JOIN gone g ON g.registro = s.registro AND g.linha_no = s.linha_no WHERE g.registro IS NULL GROUP BY s.registro) k ON k.registro = c.registro""",
    }
