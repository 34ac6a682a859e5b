"""Queries on pages made from the corpus, answers, sources and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions import html as H
from tessitura.functions import text as T
from tessitura.functions.keys import loose_id
from tessitura.operators import ingest, runs
from tessitura.plans.registry import register
from tessitura.session import table

_PAGE = """pages AS (SELECT registro, '<html><head><style>p { margin: 0 }</style></head><nav><a href="#top">topo</a></nav><h1>' || titulo || '</h1>'
  || array_to_string(list_transform(string_split(texto, chr(10)), lambda x: '<p class="t">' || replace(replace(x, '&', '&amp;'), '<', '&lt;') || '</p>'), '')
  || '<a href="' || url_original || '?v=1">Original <b>' || formato_original || '</b></a><a href="' || url_original || '?v=1">de novo</a><footer><p>Rodapé da página do acervo</p></footer></html>' AS html
  FROM corpus WHERE texto IS NOT NULL AND titulo IS NOT NULL AND url_original IS NOT NULL AND formato_original IS NOT NULL)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages of the corpus: its lines as paragraphs, among navigation, style, links and a footer."""
    c = table(spark, sf_dir, "corpus").where("texto is not null and titulo is not null and url_original is not null and formato_original is not null")
    escaped = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(F.split("texto", "\n", -1), lambda x: F.concat(F.lit('<p class="t">'), escaped(x), F.lit("</p>"))), "")
    link = lambda text: F.concat(F.lit('<a href="'), "url_original", F.lit('?v=1">'), text, F.lit("</a>"))
    return c.select("registro", F.concat(
        F.lit('<html><head><style>p { margin: 0 }</style></head><nav><a href="#top">topo</a></nav><h1>'), "titulo", F.lit("</h1>"), body,
        link(F.concat(F.lit("Original <b>"), "formato_original", F.lit("</b>"))), link(F.lit("de novo")), F.lit("<footer><p>Rodapé da página do acervo</p></footer></html>")).alias("html"))


_EDGE = r"'^[\s\p{Z}\x{85}\x1c-\x1f]+|[\s\p{Z}\x{85}\x1c-\x1f]+$'"
_PLAIN = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@register("WITH " + _PAGE + rf""", bare AS (SELECT registro, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style\b.*?</style>', '', 'g'), '(?is)<nav\b.*?</nav>', '', 'g'), '(?is)<footer\b.*?</footer>', '', 'g') AS html FROM pages),
ps AS (SELECT registro, list_filter(list_transform(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda p: regexp_replace({_PLAIN.format("regexp_replace(p, '<[^>]*>', '', 'g')")}, {_EDGE}, '', 'g')), lambda t: length(t) > 10) AS ps FROM bare)
SELECT registro, CAST(len(ps) AS INT) AS paragraphs, md5(array_to_string(ps, chr(10) || chr(10))) AS digest, CASE WHEN length(array_to_string(ps, chr(10) || chr(10))) > 1000 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS quality FROM ps""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = H.html_text(F.col("html"))
    return _pages(spark, sf_dir).select("registro", F.size(H.paragraphs(F.col("html"))).alias("paragraphs"), F.md5(text).alias("digest"), H.html_quality(text).alias("quality"))


@register("WITH " + _PAGE + """SELECT registro, url_original || '?v=1' AS url, 'Original ' || formato_original AS title,
  CASE WHEN regexp_matches(url_original, '(?i)\\.pdf$') THEN 'pdf' WHEN regexp_matches(url_original, '(?i)\\.docx?$') THEN 'docx' WHEN regexp_matches(url_original, '(?i)\\.xlsx?$') THEN 'xlsx' WHEN regexp_matches(url_original, '(?i)\\.html?$') THEN 'html' END AS format
FROM pages JOIN corpus USING (registro)""".replace("\\\\", "\\"))
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File links of each page: the first of a URL, with its title and format."""
    found = _pages(spark, sf_dir).select("registro", F.posexplode(H.links(F.col("html"))).alias("pos", "l")).select("registro", "pos", F.col("l.href").alias("url"), F.col("l.title").alias("title"))
    first = ingest.latest_per_key(found, ("registro", "url"), F.asc("pos"))
    return first.select("registro", "url", "title", H.file_format(F.col("url")).alias("format"))


_EMPTY = r"'(?i)\**==>\s*(?:picture|figura)[^<]*<==\**'"


# The answer without parsing: the page's title, lines and links with their marks.
@register("WITH " + _PAGE + rf""", md AS (SELECT registro, regexp_replace(regexp_replace('# ' || titulo || chr(10) || chr(10) || array_to_string(list_transform(string_split(texto, chr(10)), lambda x: chr(10) || chr(10) || x || chr(10) || chr(10)), '')
  || 'Original **' || formato_original || '**de novo', chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), {_EDGE}, '', 'g') AS markdown FROM pages JOIN corpus USING (registro))
SELECT registro, markdown, len(regexp_extract_all(regexp_replace(regexp_replace(markdown, {_EMPTY}, ' ', 'g'), '[*_`#~>|\-]+', ' ', 'g'), '[A-Za-zÀ-ÿ0-9]{{3,}}')) >= 10 AS useful FROM md""")
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = H.html_markdown(F.col("html"))
    return _pages(spark, sf_dir).select("registro", md.alias("markdown"), T.useful_markdown(md).alias("useful"))


@register("SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS VARCHAR) AS value FROM events")
def repeats_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events encoded as runs, page by page, and decoded again."""
    columns = ["event_type", "user_id", "value"]
    pages = table(spark, sf_dir, "events").select((F.col("event_id") / 500).cast("long").alias("page"), "event_id", "event_type", F.col("user_id").cast("string").alias("user_id"), F.col("value").cast("string").alias("value"))
    encoded = runs.encode_repeats(pages, "page", "event_id", columns)
    return runs.decode_repeats(encoded, "page", "event_id", columns).drop("page")


_CTX = """ctx AS (SELECT question_id, list(struct_pack(p := pos, l := s.citation_label, t := s.support_excerpt) ORDER BY pos) AS c FROM (
  SELECT question_id, unnest(range(len(relevant_sources))) AS pos, unnest(relevant_sources) AS s FROM gt_questions) WHERE s.support_excerpt IS NOT NULL GROUP BY question_id)"""
_FLAT = r"array_to_string(list_filter(string_split_regex({}, '[\s\p{{Z}}\x{{85}}\x1c-\x1f]+'), lambda w: w <> ''), ' ')"


@register("WITH " + _CTX + rf""" SELECT question_id, array_to_string(list_transform(c[1:3], lambda x: substr({_FLAT.format('x.t')}, 1, 500)), chr(10) || chr(10)) AS answer,
  md5(array_to_string(list_transform(range(1, len(c) + 1), lambda i: '[' || i || '] ' || coalesce(c[i].l, '') || chr(10) || c[i].t), chr(10) || chr(10))) AS prompt FROM ctx""")
def answers_and_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer made of a question's first three contexts, and the numbered contexts of its prompt."""
    s = table(spark, sf_dir, "gt_questions").select("question_id", F.posexplode("relevant_sources").alias("pos", "s")).where("s.support_excerpt is not null")
    held = F.array_sort(F.collect_list(F.struct("pos", F.col("s.citation_label").alias("l"), F.col("s.support_excerpt").alias("t"))))
    c = s.groupBy("question_id").agg(held.alias("c"))
    answer = F.array_join(F.transform(F.slice("c", 1, 3), lambda x: F.substring(T.collapse(x["t"]), 1, 500)), "\n\n")
    prompt = F.array_join(F.transform("c", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["l"], F.lit("")), F.lit("\n"), x["t"])), "\n\n")
    return c.select("question_id", answer.alias("answer"), F.md5(prompt).alias("prompt"))


@register(r"""WITH src AS (SELECT question_id, unnest(range(len(relevant_sources))) AS pos, unnest(relevant_sources) AS s FROM gt_questions),
cat AS (SELECT lower(trim(id)) AS id, arg_min(tipo, registro) AS tipo, arg_min(subtipo, registro) AS subtipo, list_distinct(list(url_original) FILTER (WHERE url_original IS NOT NULL)) AS urls FROM corpus GROUP BY 1)
SELECT question_id, CAST(pos AS INT) AS pos, cat.id IS NOT NULL AS exists, coalesce(cat.tipo = s.tipo, FALSE) AS same_tipo, coalesce(cat.subtipo = s.subtipo, FALSE) AS same_subtipo,
  coalesce(list_contains(cat.urls, s.url), FALSE) AS known_url FROM src LEFT JOIN cat ON cat.id = lower(regexp_replace(s.document_id, '^\s+|\s+$', '', 'g'))""")
def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "gt_questions").select("question_id", F.posexplode("relevant_sources").alias("pos", "s")).withColumn("key", loose_id(F.col("s.document_id")))
    first = lambda c: F.min_by(c, "registro")
    cat = table(spark, sf_dir, "corpus").groupBy(loose_id(F.col("id")).alias("key")).agg(first("tipo").alias("tipo"), first("subtipo").alias("subtipo"), F.collect_set("url_original").alias("urls"), F.lit(True).alias("exists"))
    no = lambda c: F.coalesce(c, F.lit(False))
    joined = s.join(cat, "key", "left")
    return joined.select("question_id", "pos", no(F.col("exists")).alias("exists"), no(F.col("tipo") == F.col("s.tipo")).alias("same_tipo"), no(F.col("subtipo") == F.col("s.subtipo")).alias("same_subtipo"), no(F.array_contains("urls", F.col("s.url"))).alias("known_url"))


@register("""SELECT n_name, r_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) FILTER (WHERE l_returnflag = 'R') AS returned
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    money = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    # Orders are counted by their first line, so that no distinct count is needed.
    each = joined.groupBy("n_name", "r_name", "o_orderkey").agg(money.alias("m"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return each.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.round(F.sum("m"), 2).alias("revenue"), F.sum("r").alias("returned"))


@register("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@register("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@register("""SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "r")


@register("""SELECT user_id, CAST(sum(n) AS BIGINT) AS events, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM (
  SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY ALL) GROUP BY user_id""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTE")).cast("int"), F.lit(1))
    return table(spark, sf_dir, "events").select("user_id", fresh.alias("fresh")).groupBy("user_id").agg(F.count("*").alias("events"), F.sum("fresh").alias("sessions"))
