"""Lines that recur across the documents of one source.

Every source's documents are one sequence of line identifiers.  Its suffixes,
cut at the document's end and at a number of lines, are sorted by a range
partitioning, which is the suffix array in parts of even size, however often a
line recurs.  The common prefix of neighbours in that order gives, for every
depth, the runs of suffixes that begin with the same block of lines; a run that
lies within a batch is counted there, a run at a batch's edge hands on its
documents and is counted by an aggregation.  Blocks that span enough documents
are deleted, line by line.

Where whole blocks are wanted, the suffixes that begin with a spanning block of
the full depth are sorted again with twice the depth, until no block is longer;
of blocks in as many places as a longer one that holds them, the longest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.session import materialize

#: Lines of a suffix that are compared at first.
DEPTH = 4

_RUNS = pa.schema([("source", pa.string()), ("depth", pa.int32()), ("block", pa.list_(pa.int64())), ("doc", pa.int64()), ("docs", pa.int64()), ("places", pa.int64())])


def letters(line: Column) -> Column:
    """The letters of a line in order, in lower case: what makes lines the same."""
    return F.lower(F.regexp_replace(line, r"\P{L}+", ""))


def line_table(df: DataFrame, row_col: str, doc_col: str, source_col: str, text_col: str, min_letters: int) -> DataFrame:
    """Per row its eligible lines: numbers (from 1) and identifiers."""
    keys = F.transform(F.split(F.col("text"), "\n", -1), letters)
    numbered = F.filter(
        F.transform(keys, lambda k, i: F.struct((i + 1).alias("no"), F.when(F.length(k) >= min_letters, F.xxhash64(k)).alias("line"))),
        lambda x: x["line"].isNotNull(),
    )
    rows = df.select(df[row_col].alias("row"), df[doc_col].alias("doc_id"), df[source_col].alias("source"), df[text_col].alias("text"))
    return (
        rows.where("text is not null and source is not null")
        .select("row", "source", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("doc"), numbered.alias("lines"))
        .where(F.size("lines") > 0)
        .select("row", "source", "doc", F.col("lines.no").alias("nos"), F.col("lines.line").alias("lines"))
    )


def _runs(batches: Iterator[pa.RecordBatch], depth: int, min_docs: int, beyond: int) -> Iterator[pa.RecordBatch]:
    """Runs of equal prefixes in sorted suffixes: counted ones (``doc`` null),
    and the documents of those that may go on in another batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        source = batch.column(0)
        _, src = np.unique(source.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        doc = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        lines = np.stack([batch.column(2 + d).to_numpy(zero_copy_only=False).astype(np.int64) for d in range(depth)])
        there = np.cumprod(lines != 0, axis=0).astype(bool)
        same = np.zeros((depth, n), bool)
        same[:, 1:] = lines[:, 1:] == lines[:, :-1]
        same[0, 1:] &= src[1:] == src[:-1]
        common = np.cumprod(same, axis=0).sum(axis=0)  # lines shared with the suffix before
        for d in range(beyond + 1, depth + 1):
            run = np.cumsum(common < d) - 1
            at = np.flatnonzero(there[d - 1])
            if not len(at):
                break
            pairs = np.unique(np.stack([run[at], doc[at]]), axis=1) if len(at) > 1 else np.stack([run[at], doc[at]])
            first = np.zeros(run[-1] + 1, np.int64)
            first[run[::-1]] = np.arange(n)[::-1]
            docs = np.bincount(pairs[0][pairs[1] != 0], minlength=run[-1] + 1)
            places = np.bincount(run[at], minlength=run[-1] + 1)
            edge = np.zeros(run[-1] + 1, bool)
            edge[[0, run[-1]]] = True
            whole = np.flatnonzero(~edge & (docs >= min_docs))
            open_ = edge[pairs[0]]
            started = np.unique(pairs[0][open_], return_index=True)
            held = np.zeros(int(open_.sum()), np.int64)
            held[started[1]] = places[started[0]]
            own = np.concatenate([whole, pairs[0][open_]])
            starts = first[own]
            yield pa.RecordBatch.from_arrays(
                [
                    source.take(pa.array(starts)),
                    pa.array(np.full(len(own), d, np.int32)),
                    pa.array(list(lines[:d, starts].T), pa.list_(pa.int64())),
                    pa.array(np.concatenate([np.zeros(len(whole), np.int64), pairs[1][open_]]), mask=np.concatenate([np.ones(len(whole), bool), np.zeros(int(open_.sum()), bool)])),
                    pa.array(np.concatenate([docs[whole], np.zeros(int(open_.sum()), np.int64)])),
                    pa.array(np.concatenate([places[whole], held])),
                ],
                schema=_RUNS,
            )


def repeated_blocks(lines: DataFrame, depth: int, min_docs: int, heads: DataFrame | None = None, beyond: int = 0) -> DataFrame:
    """``source, depth, block array<long>, docs, places``: every block of more
    than ``beyond`` and up to ``depth`` consecutive lines that begins suffixes
    of ``min_docs`` or more documents. Rows without document id count as places
    only. With ``heads`` (``source, head array<long>``, of ``beyond`` lines)
    only suffixes that begin with one of them are sorted."""
    follow = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.slice("lines", i, depth))
    suffix = lines.select("source", F.coalesce("doc", F.lit(0)).alias("doc"), F.explode(follow).alias("s"))
    if heads is not None:
        suffix = suffix.where(F.size("s") > beyond).withColumn("head", F.slice("s", 1, beyond)).join(heads, ["source", "head"], "left_semi")
    heads_ = [F.coalesce(F.try_element_at("s", F.lit(d + 1)), F.lit(0)).alias(f"l{d}") for d in range(depth)]
    order = ["source", *(f"l{d}" for d in range(depth)), "doc"]
    suffixes = suffix.select("source", "doc", *heads_).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "source string, depth int, block array<bigint>, doc bigint, docs bigint, places bigint"
    runs = suffixes.mapInArrow(lambda batches: _runs(batches, depth, min_docs, beyond), kinds)
    # Documents of a run at an edge are made distinct before they are counted; counted runs pass as they are.
    distinct = runs.groupBy("source", "depth", "block", "doc").agg(F.sum("docs").alias("docs"), F.sum("places").alias("places"))
    known = F.count(F.when(F.col("doc") != 0, True))
    joined = distinct.groupBy("source", "depth", "block").agg((F.sum("docs") + known).alias("docs"), F.sum("places").alias("places"))
    return joined.where(F.col("docs") >= min_docs)


def _spanning(df: DataFrame, row_col: str, doc_col: str, source_col: str, text_col: str, min_letters: int, min_docs: int, min_share: float, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = materialize(line_table(df, row_col, doc_col, source_col, text_col, min_letters), "lines")
    totals = df.select(df[source_col].alias("source"), df[doc_col].alias("doc")).where("source is not null").groupBy("source").agg(F.countDistinct("doc").alias("source_docs"))
    blocks = repeated_blocks(lines, depth, min_docs).join(totals, "source").where(F.col("docs") >= F.col("source_docs") * min_share)
    return lines, blocks, totals


def find_repeated_lines(
    df: DataFrame, row_col: str, doc_col: str, source_col: str, text_col: str,
    min_letters: int = 15, min_docs: int = 5, min_share: float = 0.05, depth: int = DEPTH,
) -> DataFrame:
    """``row_col`` and ``line_no`` of every line to be removed.

    Lines are what ``\\n`` separates, counted from 1; two are the same if their
    letters are, whatever their case; lines of fewer than ``min_letters``
    letters stay.  A block goes if it is in ``min_docs`` documents of its
    source and in ``min_share`` of them.

    Null and empty texts have no lines; rows without source belong to no site
    and stay whole; rows without document id don't count as a document, their
    lines go if others make them a case; repeated rows count once as a
    document; an empty table gives no rows.
    """
    lines, blocks, _ = _spanning(df, row_col, doc_col, source_col, text_col, min_letters, min_docs, min_share, depth)
    # Every line of such a block: at most 1 / min_share times the mean lines of a document, per source.
    gone = blocks.select("source", F.explode("block").alias("line")).distinct()
    each = lines.select("row", "source", F.explode(F.arrays_zip("nos", "lines")).alias("at")).select("row", "source", F.col("at.nos").alias("line_no"), F.col("at.lines").alias("line"))
    return each.join(gone, ["source", "line"], "left_semi").select(F.col("row").alias(row_col), F.col("line_no").cast("long").alias("line_no"))


def find_repeated_blocks(
    df: DataFrame, row_col: str, doc_col: str, source_col: str, text_col: str,
    min_letters: int = 15, min_docs: int = 5, min_share: float = 0.05, depth: int = DEPTH,
) -> DataFrame:
    """``source, n_lines, docs, places, source_docs`` of each block that goes,
    however long, unless a block of one line more holds it in as many places.
    ``depth`` is where the search begins; it doubles while blocks reach it."""
    lines, blocks, totals = _spanning(df, row_col, doc_col, source_col, text_col, min_letters, min_docs, min_share, depth)
    totals = materialize(totals, "totals")
    levels = [materialize(blocks, "blocks")]
    while True:
        heads = levels[-1].where(F.col("depth") == depth).select("source", F.col("block").alias("head"))
        if heads.isEmpty():
            break
        longer = repeated_blocks(lines, 2 * depth, min_docs, heads, depth).join(totals, "source").where(F.col("docs") >= F.col("source_docs") * min_share)
        levels.append(materialize(longer, "blocks"))
        depth *= 2
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    # A block of n lines is held by those of n + 1 that begin or end with it.
    shorter = F.explode(F.array(F.expr("slice(block, 1, depth - 1)"), F.expr("slice(block, 2, depth - 1)"))).alias("block")
    held = every.where("depth > 1").select("source", shorter, "places").distinct()
    closed = every.join(held, ["source", "block", "places"], "left_anti")
    return closed.select("source", F.col("depth").alias("n_lines"), "docs", "places", "source_docs")


def remove_repeated_lines(df: DataFrame, row_col: str, doc_col: str, source_col: str, text_col: str, **limits) -> DataFrame:
    """``row_col``, ``text`` without its repeated lines, and ``removed int``.
    Texts without any come out as they are, null texts as null."""
    found = find_repeated_lines(df, row_col, doc_col, source_col, text_col, **limits)
    nos = found.groupBy(row_col).agg(F.sort_array(F.collect_set(F.col("line_no").cast("int"))).alias("gone"))
    rows = df.select(row_col, df[text_col].alias("text")).join(nos, row_col, "left")

    def kept(parts: Column) -> Column:
        """The stretches between removed lines, by their positions."""
        before, after = F.concat(F.array(F.lit(0)), "gone"), F.concat("gone", F.array(F.size(parts) + 1))
        return F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice(parts, a + 1, b - a - 1))), "\n")

    text = F.transform(F.array(F.split("text", "\n", -1)), kept)[0]
    return rows.select(row_col, F.when(F.col("gone").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
