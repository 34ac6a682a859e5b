"""Chunking strategies as column expressions: word windows, articles, sections,
parents and children.  A document never leaves its row until it is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions import text as T
from tessitura.functions.keys import strip

FIXED = (512, 64)
STRUCTURAL = (800, 80)
CHILD = (300, 40)
MIN_MERGE = 50
_ARTICLE_MARK, _BLOCK_MARK = "\u0001", "\u0002"


def check_window(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be at least 0 and below the size, got {overlap} and {size}")


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that share ``overlap`` words; the one that
    reaches the end is the last. No words, no window."""
    check_window(size, overlap)
    words, step = T.words(text), size - overlap
    n = F.size(words)
    count = F.greatest(F.lit(1), F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    each = lambda i: F.array_join(F.slice(words, i * step + 1, size), " ")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), each)).otherwise(F.array().cast("array<string>"))


def fixed_size_chunks(df: DataFrame, doc_col: str, text_col: str, size: int = FIXED[0], overlap: int = FIXED[1]) -> DataFrame:
    """``doc_col, chunk_index, texto``; null and blank texts have no chunks."""
    return df.select(doc_col, F.posexplode(word_windows(F.col(text_col), size, overlap)).alias("chunk_index", "texto"))


def split_if_long(text: Column, size: int = STRUCTURAL[0], overlap: int = STRUCTURAL[1]) -> Column:
    """The stripped text, or its word windows where it has more than ``size`` words."""
    return F.when(F.size(T.words(text)) <= size, F.array(strip(text))).otherwise(word_windows(text, size, overlap))


def cut_before(text: Column, pattern: str, mark: str) -> Column:
    """The text cut before every match: element 0 is what precedes the first."""
    return F.split(F.regexp_replace(text, pattern, mark + "$0"), mark)


def merge_small(blocks: Column, least: int = MIN_MERGE, most: int = STRUCTURAL[0]) -> Column:
    """Neighbouring short blocks become one of ``least`` words or more, closed
    before it would pass ``most``; a short rest joins the last one."""
    kind = "struct<done:array<string>,held:array<string>,words:int>"
    start = F.from_json(F.lit('{"done":[],"held":[],"words":0}'), kind)
    made = lambda done, held, words: F.struct(done.alias("done"), held.alias("held"), words.cast("int").alias("words"))
    none, glue = F.array().cast("array<string>"), "\n\n"

    # Words are counted once per block, before the fold uses the count several times.
    counted = F.transform(blocks, lambda b: F.struct(b.alias("text"), F.size(T.words(b)).alias("n")))

    def add(s: Column, counted_block: Column) -> Column:
        block, n = counted_block["text"], counted_block["n"]
        full = (F.size(s["held"]) > 0) & (s["words"] + n > most)
        done = F.when(full, F.concat(s["done"], F.array(F.array_join(s["held"], glue)))).otherwise(s["done"])
        held = F.concat(F.when(full, none).otherwise(s["held"]), F.array(block))
        words = F.when(full, 0).otherwise(s["words"]) + n
        close = words >= least
        return made(F.when(close, F.concat(done, F.array(F.array_join(held, glue)))).otherwise(done), F.when(close, none).otherwise(held), F.when(close, 0).otherwise(words))

    def finish(s: Column) -> Column:
        rest = F.array_join(s["held"], glue)
        last = F.concat(F.element_at(s["done"], -1), F.lit(glue), rest)
        return (
            F.when(F.size(s["held"]) == 0, s["done"])
            .when(F.size(s["done"]) == 0, F.array(rest))
            .otherwise(F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(last)))
        )

    return F.aggregate(counted, start, add, finish)


def fallback_blocks(text: Column) -> Column:
    """Blocks of a text without articles: cut at sections and headings, else at
    blank lines; short ones merged."""
    marked = F.regexp_replace(F.regexp_replace(text, T.SECTION, _BLOCK_MARK + "$0"), T.HEADING, _BLOCK_MARK + "$0")
    parts = F.when(marked.contains(_BLOCK_MARK), F.split(marked, _BLOCK_MARK + "+")).otherwise(F.split(text, r"\n[\s\p{Z}]*\n+"))
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    return merge_small(F.when(F.size(kept) > 0, kept).otherwise(F.array(strip(text))))


def article_segments(df: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """``doc_col, position, artigo, secao, segment`` of each article; what
    precedes the first article is dropped. ``secao`` is the nearest section
    title at or before the article's start."""
    w = Window.partitionBy(doc_col).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.select(doc_col, F.posexplode(cut_before(F.col(text_col), T.ARTICLE, _ARTICLE_MARK)).alias("position", "part"))
    titles = F.transform(F.regexp_extract_all("part", F.lit(T.SECTION), 1), T.collapse)
    last = F.when(F.size(titles) > 0, F.element_at(titles, -1))
    # The titles of earlier parts precede this article, those of its own follow it.
    return (
        parts.withColumn("secao", F.last(last, ignorenulls=True).over(w))
        .where("position > 0")
        .select(doc_col, "position", T.first_match(F.col("part"), T.ARTICLE).alias("artigo"), "secao", strip(F.col("part")).alias("segment"))
    )


def article_aware_chunks(df: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """``doc_col, chunk_index, chunk_level, secao, artigo, paragrafo, inciso,
    alinea, texto`` by articles, or by sections and paragraphs where a text has
    none. Markers are those of the whole article, on each of its parts."""
    texts = df.where(F.length(strip(F.col(text_col))) > 0)
    has = F.col(text_col).rlike(T.ARTICLE)
    segments = article_segments(texts.where(has), doc_col, text_col)
    s = F.col("segment")
    articles = segments.select(
        doc_col, "position", F.lit("article").alias("chunk_level"), "secao", "artigo", T.first_match(s, T.PARAGRAPH).alias("paragrafo"),
        T.first_match(s, T.INCISO).alias("inciso"), T.first_match(s, T.ALINEA).alias("alinea"), F.posexplode(split_if_long(s)).alias("part", "texto"),
    )
    blocks = texts.where(~has).select(doc_col, F.posexplode(fallback_blocks(F.col(text_col))).alias("position", "segment"))
    title = T.first_match(s, T.SECTION)
    none = F.lit(None).cast("string")
    others = blocks.select(
        doc_col, "position", F.when(title.isNotNull(), "section").otherwise("paragraph").alias("chunk_level"), title.alias("secao"),
        none.alias("artigo"), none.alias("paragrafo"), none.alias("inciso"), none.alias("alinea"), F.posexplode(split_if_long(s)).alias("part", "texto"),
    )
    order = Window.partitionBy(doc_col).orderBy("position", "part")
    both = articles.unionByName(others).withColumn("chunk_index", F.row_number().over(order) - 1)
    return both.select(doc_col, "chunk_index", "chunk_level", "secao", "artigo", "paragrafo", "inciso", "alinea", "texto")


def parent_child_chunks(df: DataFrame, doc_col: str, text_col: str, size: int = CHILD[0], overlap: int = CHILD[1]) -> DataFrame:
    """Parents (article-aware) with their children: ``doc_col, parent_index,
    child_index, texto``; children are counted across the document's parents."""
    parents = article_aware_chunks(df, doc_col, text_col)
    children = parents.select(doc_col, F.col("chunk_index").alias("parent_index"), F.posexplode(word_windows(F.col("texto"), size, overlap)).alias("part", "texto"))
    order = Window.partitionBy(doc_col).orderBy("parent_index", "part")
    return children.select(doc_col, "parent_index", (F.row_number().over(order) - 1).alias("child_index"), "texto")


STRATEGIES = {"fixed-size": fixed_size_chunks, "article-aware": article_aware_chunks, "hierarchical": article_aware_chunks, "hierarchical-child": parent_child_chunks}


def generate_chunks(df: DataFrame, doc_col: str, text_col: str, strategies: tuple[str, ...] = ("fixed-size", "article-aware")) -> DataFrame:
    """The chunks of several strategies in one table, absent columns null."""
    out = None
    for name in strategies:
        one = STRATEGIES[name](df, doc_col, text_col).withColumn("chunk_strategy", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
