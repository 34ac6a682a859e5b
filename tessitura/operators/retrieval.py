"""Retrieval: exact nearest neighbours of a query set, filters, expansion, ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions import text as T
from tessitura.functions.keys import strip
from tessitura.schemas import EXCLUDED_STATUS

POOL_FACTOR, POOL_LEAST = 5, 50
#: Rows of a block of items and of queries, and copies of the query blocks that spread the item blocks of a part.
ITEM_BLOCK, QUERY_BLOCK, SALTS = 2_048, 256, 8


def pool_size(k: int, override: int | None = None, widened: bool = False) -> int:
    """Candidates to fetch for ``k`` results: more when a step will drop some."""
    if k <= 0:
        raise ValueError("k must be positive")
    return max(override, k) if override is not None else max(POOL_FACTOR * k, POOL_LEAST) if widened else k


def pool_size_column(k: int) -> Column:
    """The same for each row of a table of configurations."""
    widened = F.col("rerank") | (F.col("mode") == "hierarchical") | F.col("exclude_revogadas") | F.col("exclude_superseded_versions") | F.col("restrict_to_query_submodulo")
    usual = F.when(widened, F.lit(max(POOL_FACTOR * k, POOL_LEAST))).otherwise(F.lit(k))
    return F.greatest(F.coalesce("candidates_k_override", usual), F.lit(k))


def norm(vector: Column) -> Column:
    v = vector.cast("array<double>")
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(vector: Column) -> Column:
    """The vector at length one; zero vectors stay as they are."""
    n = norm(vector)
    return F.transform(vector.cast("array<double>"), lambda x: x / F.when(n > 0, n).otherwise(1.0))


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (``part, item, vector``) as blocks: one row with the items in order and their unit vectors as a matrix."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).sort_by([("part", "ascending"), ("item", "ascending")]).combine_chunks()
        parts = table.column("part").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        at = np.unique(np.concatenate([np.arange(a, b, rows) for a, b in zip(starts, np.append(starts[1:], len(parts)))]))
        vectors, ends = table.column("vector").combine_chunks(), np.append(at[1:], len(parts))
        matrices = []
        for a, b in zip(at, ends):
            block = vectors.slice(a, b - a)
            x = block.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(x) % (b - a) or len(set(block.value_lengths().to_pylist())) > 1:
                raise ValueError("vectors of one part must have one length")
            x = x.reshape(b - a, -1)
            matrices.append((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).tobytes())
        items = pa.ListArray.from_arrays(pa.array(np.append(at, len(parts)).astype(np.int32)), table.column("item").combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array(parts[at]), items, pa.array(matrices, pa.binary())], names=["part", "items", "matrix"])


def _partial_top(batches: Iterator[pa.RecordBatch], k: int, decimals: int) -> Iterator[pa.RecordBatch]:
    """Of each query of a block its best items of the other block, ties to the smaller item."""
    for batch in batches:
        for row in range(batch.num_rows):
            asked, held = (batch.column(c)[row].values for c in ("queries", "items"))
            q, x = (np.frombuffer(batch.column(c)[row].as_buffer()).reshape(len(n), -1) for c, n in (("asking", asked), ("matrix", held)))
            if x.shape[1] != q.shape[1]:
                raise ValueError("queries and items have vectors of different lengths")
            score = np.round(q @ x.T, decimals)
            names, items = (c.to_numpy(zero_copy_only=False) for c in (asked, held))
            rows, cols = [], []
            for i in range(len(names)):
                near = np.flatnonzero(score[i] >= np.partition(score[i], -(k + 1))[-(k + 1)]) if len(items) > k + 1 else np.arange(len(items))
                best = near[np.argsort(-score[i][near], kind="stable")]
                best = best[items[best] != names[i]][:k]
                rows.append(np.full(len(best), i))
                cols.append(best)
            rows, cols = np.concatenate(rows), np.concatenate(cols)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("part")[row].as_py()] * len(rows), pa.string()), asked.take(pa.array(rows)), held.take(pa.array(cols)), pa.array(score[rows, cols])], names=["part", "query", "item", "score"]
            )


def exact_top_k(queries: DataFrame, items: DataFrame, k: int, decimals: int = 9) -> DataFrame:
    """``part, query, item, score, rank`` of the ``k`` items of largest cosine
    in each part.

    ``queries``: ``query, vector``; ``items``: ``item, vector``; both may have
    a string ``part``, and a query meets the items of its part only.  An item
    is no neighbour of the query that is equal to it.  Blocks of queries meet
    blocks of items, so a vector is sent once per block it meets; each pair of
    blocks keeps ``k`` per query.
    """
    def blocks(df: DataFrame, key: str, rows: int) -> DataFrame:
        part = F.coalesce("part", F.lit("")) if "part" in df.columns else F.lit("")
        held = df.select(part.alias("part"), F.col(key).alias("item"), "vector").where("item is not null and vector is not null")
        kind = df.schema[key].dataType.simpleString()
        return held.mapInArrow(lambda b: _blocks(b, rows), f"part string, items array<{kind}>, matrix binary")

    asking = blocks(queries, "query", QUERY_BLOCK).select("part", F.col("items").alias("queries"), F.col("matrix").alias("asking"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = blocks(items, "item", ITEM_BLOCK).withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("query", queries), ("item", items)))
    # A stated query set, in blocks, against all items.
    met = held.join(asking, ["part", "salt"]).select("part", "queries", "asking", "items", "matrix")
    partial = met.mapInArrow(lambda b: _partial_top(b, k, decimals), f"part string, {kinds}, score double")
    w = Window.partitionBy("part", "query").orderBy(F.desc("score"), "item")
    found = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found if "part" in items.columns else found.drop("part")


class _Dimensions(dict):
    """Dimension of a token, by the first half word of its digest."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        d = self[token] = int.from_bytes(hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()[:4], "big") % self.dims
        return d


def hash_vector(text: Column, dims: int = 64) -> Column:
    """Hash embedding of length one: a token adds 1 to the dimension of its
    hash; null where there are no tokens.  Made in Arrow batches: counting
    dimensions with array functions takes text length x ``dims`` steps a row."""
    known = _Dimensions(dims)

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            held = t.split() if t else ()
            v = np.bincount(np.fromiter(map(known.__getitem__, held), np.int64, len(held)), minlength=dims).astype(np.float64) if held else None
            out.append(None if v is None else v / np.sqrt((v * v).sum()))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(F.lower(text))


def hash_embedding(df: DataFrame, key: str, text_col: str, dims: int = 64) -> DataFrame:
    """``key, dim, value``: the same as sparse rows; texts without tokens have none."""
    return df.select(key, F.posexplode(hash_vector(F.col(text_col), dims)).alias("dim", "value")).where("value > 0")


def passes_status(status: Column, excluded: tuple[str, ...] = EXCLUDED_STATUS) -> Column:
    """A null status passes."""
    return ~F.coalesce(F.lower(strip(status)).isin(*excluded), F.lit(False))


def superseded(documents: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Versioned ids that aren't kept: of each module the largest version stays,
    and of its ids those with an official suffix, if any has one."""
    ids = documents.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct()
    v = ids.select(id_col, T.module_key(F.col(id_col)).alias("module"), T.version(F.col(id_col)).alias("version"), F.col(id_col).rlike(T.OFFICIAL).alias("official"))
    v = v.where("module is not null and version is not null")
    top = v.groupBy("module").agg(F.max("version").alias("top"))
    at_top = v.join(top, "module").withColumn("newest", F.col("version") == F.col("top"))
    official = at_top.where("newest").groupBy("module").agg(F.bool_or("official").alias("any_official"))
    kept = F.col("newest") & (F.col("official") | ~F.col("any_official"))
    return at_top.join(official, "module").where(~kept).select(id_col, "module")


def expand_to_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Replace child hits (``query, chunk_id, parent_chunk_id, score, rank``) by
    their parents, each with its best child's score; unknown parents fall out."""
    known = parents.select(F.col("chunk_id").alias("parent_chunk_id")).distinct()
    joined = hits.where("parent_chunk_id is not null").join(known, "parent_chunk_id")
    best = Window.partitionBy("query", "parent_chunk_id").orderBy(F.desc("score"), "rank")
    single = joined.withColumn("_b", F.row_number().over(best)).where("_b = 1")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rank")
    return single.select("query", "parent_chunk_id", "score", F.row_number().over(order).alias("rank"))


def lexical_share(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that a text has: a reranker without a model."""
    asked = F.array_distinct(T.words(F.lower(query)))
    return F.size(F.array_intersect(asked, T.words(F.lower(text)))) / F.greatest(F.lit(1), F.size(asked))


def of_named_module(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query, chunk_id`` of the chunks of documents of the submodule that a
    query (``query, question``) names: joined on the submodule."""
    q = queries.select("query", T.query_module(F.col("question")).alias("module")).where("module is not null")
    documents = chunks.select("document_id").distinct()
    named = F.array_distinct(F.regexp_extract_all("document_id", F.lit(r"(?:subm|rede-)(\d+-\d+[a-z]?)(?![0-9a-z])"), 1))
    d = documents.select("document_id", F.explode(named).alias("module"))
    met = q.join(d, "module").where(T.matches_module(F.col("document_id"), F.col("module"))).select("query", "document_id")
    return met.join(chunks.select("document_id", "chunk_id"), "document_id").select("query", "chunk_id").distinct()


def inject(candidates: DataFrame, matching: DataFrame) -> DataFrame:
    """Add matching chunks that aren't candidates yet (``query, chunk_id``), with score 0."""
    fresh = matching.select("query", "chunk_id").distinct().join(candidates, ["query", "chunk_id"], "left_anti")
    return candidates.unionByName(fresh.withColumn("score", F.lit(0.0)))


def best_first(candidates: DataFrame, k: int) -> DataFrame:
    """Stable ranks by falling score, ``chunk_id`` on ties, cut at ``k``."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
