"""Extension points for models: embedders, rerankers, generators, judges.

Each is a plain callable on lists, wrapped so that Spark calls it in batches,
once per distinct input.  The defaults need no network.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions import text as T

NO_CONTEXT = "Não foram encontrados trechos para responder."
MAX_BATCH, MAX_TOKENS, BATCH_TOKENS = 2_048, 8_191, 300_000


def with_retry(call: Callable, attempts: int = 5, first: float = 1.0, longest: float = 16.0, transient: tuple = (TimeoutError, ConnectionError), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` repeated on transient errors, with growing random pauses."""

    def run(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except transient:
                if n + 1 == attempts:
                    raise
                sleep(random.uniform(first, min(longest, first * 2 ** (n + 1))))

    return run


def truncated(text: Column, n_inputs: int = MAX_BATCH) -> Column:
    """A text cut to what its share of a batch may hold, at three characters a token."""
    return F.substring(text, 1, 3 * min(MAX_TOKENS, BATCH_TOKENS // max(1, n_inputs)))


def embed(df: DataFrame, key: str, text_col: str, embedder: Callable[[list[str]], list[list[float]]], dims: int, batch: int = 256) -> DataFrame:
    """``text, embedding`` joined to ``key``: every distinct text is embedded
    once. A vector of another length than ``dims`` is an error."""
    if not 1 <= batch <= MAX_BATCH:
        raise ValueError(f"a batch has 1 to {MAX_BATCH} texts, got {batch}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = rows["text"].tolist()
            made: list[list[float]] = []
            for at in range(0, len(texts), batch):
                made.extend(embedder(texts[at : at + batch]))
            if len(made) != len(texts) or any(len(v) != dims for v in made):
                raise ValueError(f"the embedder must give one vector of {dims} numbers per text")
            yield pd.DataFrame({"text": texts, "embedding": made})

    texts = df.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    vectors = texts.mapInPandas(run, "text string, embedding array<float>")
    return df.select(key, F.col(text_col).alias("text")).join(vectors, "text").select(key, "embedding")


def lexical_scores(query: str, texts: list[str]) -> list[float]:
    """Share of the query's words that a text has: the reranker for tests."""
    wanted = set(query.lower().split())
    return [len(wanted & set(t.lower().split())) / max(1, len(wanted)) for t in texts]


def rerank(pool: DataFrame, k: int, scorer: Callable[[str, list[str]], list[float]] = lexical_scores) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the pool (``query_id, query,
    chunk_id, text, pos``) of each query scored anew; a pool is bounded by its size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        rows["score"] = [float(x) for x in scorer(rows["query"].iloc[0], rows["text"].tolist())]
        return rows.sort_values("score", ascending=False, kind="stable").head(k)[["query_id", "chunk_id", "score", "pos"]]

    kinds = pool.schema
    scored = pool.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id'].dataType.simpleString()}, chunk_id {kinds['chunk_id'].dataType.simpleString()}, score double, pos {kinds['pos'].dataType.simpleString()}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).drop("pos")


def extractive_answer(contexts: Column) -> Column:
    """First three contexts, 500 characters each; a fixed message without any."""
    parts = F.transform(F.slice(contexts, 1, 3), lambda c: F.substring(T.collapse(c), 1, 500))
    return F.when(F.size(contexts) > 0, F.array_join(parts, "\n\n")).otherwise(NO_CONTEXT)


def generate(df: DataFrame, key: str, query_col: str, contexts_col: str, generator: Callable[[str, list[str]], str] | None = None) -> DataFrame:
    """``key, answer, status, error``; without a generator, and where it fails,
    the extractive answer."""
    fallback = extractive_answer(F.col(contexts_col)).alias("fallback")
    if generator is None:
        status = F.when(F.size(contexts_col) > 0, "skipped_no_generator").otherwise("empty_contexts")
        return df.select(key, fallback.alias("answer"), status.alias("status"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, query, contexts, plain in rows.itertuples(index=False):
                try:
                    out.append((k, plain, "empty_contexts", None) if len(contexts) == 0 else (k, generator(query, list(contexts)), "ok", None))
                except Exception as e:
                    out.append((k, plain, "error", type(e).__name__))
            yield pd.DataFrame(out, columns=[key, "answer", "status", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, query_col, contexts_col, fallback).mapInPandas(run, f"{key} {kind}, answer string, status string, error string")


def guarded_expansion(original: Column, expanded: Column) -> Column:
    """The expanded query, unless it lost an identifier of the original or is blank."""
    lost = F.array_except(T.identifiers(original), T.identifiers(expanded))
    return F.when((F.size(lost) > 0) | (F.trim(F.coalesce(expanded, F.lit(""))) == ""), original).otherwise(expanded)


def score(value: Column) -> Column:
    """A judge's score between 0 and 1; null where it is no number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.try_cast("double")))
