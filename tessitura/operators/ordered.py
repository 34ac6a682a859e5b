"""Ranks and digests of sorted groups without a group in one task's memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.session import materialize


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by all columns: each group's count and the SHA-256 of its items, a line each."""
    key, n, state = None, 0, None
    for batch in batches:
        done = []
        *keys, items = (c.to_pylist() for c in batch.columns)
        for k, run in groupby(zip(zip(*keys), items), key=lambda x: x[0]):
            if k != key:
                if key is not None:
                    done.append((*key, n, state and state.hexdigest()))
                key, n, state = k, 0, None
            for _, item in run:
                n += 1
                if item is not None:
                    state = state or hashlib.sha256()
                    state.update(f"{item}\n".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, n, state and state.hexdigest()), schema.types)], schema=schema)


def ordered_digest(rows: DataFrame, keys: tuple[str, ...], item: str) -> DataFrame:
    """``*keys, n, digest`` (string keys): distinct items of each group, and the
    SHA-256 of them sorted, each with a line feed; null without an item. A group
    is sorted on disk and hashed as a stream, so its size needs no memory."""
    each = rows.select(*keys, item).distinct().repartition(*keys).sortWithinPartitions(*keys, item)
    schema = pa.schema([*((k, pa.string()) for k in keys), ("n", pa.int64()), ("digest", pa.string())])
    return each.mapInArrow(lambda b: _digests(b, schema), ", ".join([*(f"`{k}` string" for k in keys), "n long", "digest string"]))


def nearest_rank(rows: DataFrame, keys: tuple[str, ...], value: str, share: float = 0.95) -> DataFrame:
    """``*keys, n, ranked``: of each group the number of values, and the one at
    position round-half-even(share (n - 1)) of the sorted ones; nulls are no
    values, a group without any has no row.

    Equal values are counted first; their counts are sorted by a range
    partitioning. The partitions' totals tell which one holds the position.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    placed = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()), "ranks")
    totals = placed.groupBy(*keys, "_p").agg(F.sum("_c").alias("_t"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_t").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_p").alias("_q"), "_t", before.alias("_before"), F.sum("_t").over(group).alias("n"))
    totals = totals.withColumn("_place", F.bround(F.lit(share) * (F.col("n") - 1)).cast("long") + 1)
    hit = totals.where("_before < _place and _place <= _before + _t")
    held = placed.join(hit, [*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_p") == F.col("_q")])
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_v")) + F.col("_before")
    reached = held.withColumn("_upto", upto).where("_upto >= _place")
    return reached.groupBy(*keys).agg(F.first("n").alias("n"), F.min("_v").alias("ranked"))
