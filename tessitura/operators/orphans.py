"""References to records that do not exist.

Keys are cut into ranges of a uniform 64-bit order (a hash of the key), so the
ranges need no sampling and are even whatever the keys look like.  Per range
the parents become sorted arrays, references arrive as batches and are probed
by binary search; only misses leave the task.  A range that many references
hit (one hot key may hold a third of them) is split by reference, and its
parents go to every split; a range of many parents (one id may be collected
again and again) is cut into blocks, every reference visits them all, and the
last times found are put together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.times import FIRST_INSTANT

#: Keys of a range and references of a split, on average.
RANGE_ROWS = 32_768

_PROBED = "ref_table string, ref_key string, document_id string, period string, time bigint, reason string, known boolean, scraped bigint, removed bigint"


def _last_at_or_before(key_of: np.ndarray, times: np.ndarray, ref_key: np.ndarray, ref_time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per reference the largest time of its key that is at or before its own;
    whether there is one. ``key_of`` are positions in the sorted keys."""
    if not len(times) or not len(ref_key):
        return np.full(len(ref_key), FIRST_INSTANT), np.zeros(len(ref_key), bool)
    order = np.lexsort((times, key_of))
    key_of, times = key_of[order], times[order]
    steps = np.unique(times)
    width = len(steps) + 1
    codes = key_of * width + np.searchsorted(steps, times)
    probe = ref_key * width + np.searchsorted(steps, ref_time, side="right") - 1
    at = np.searchsorted(codes, probe, side="right") - 1
    hit = (at >= 0) & (key_of[np.maximum(at, 0)] == ref_key)
    return np.where(hit, times[np.maximum(at, 0)], FIRST_INSTANT), hit


def _probe(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """Misses, where the range is one block; else what this block knows of each reference."""
    columns = [c.split()[0] for c in _PROBED.split(", ")]
    if refs.empty:
        return pd.DataFrame(columns=columns)
    born = parents["born"].to_numpy(bool)
    names, times = parents["key"].to_numpy(str), parents["time"].to_numpy(np.int64)
    keys = np.unique(names) if len(names) else np.zeros(0, "U1")
    own = np.searchsorted(keys, names)
    exists = np.zeros(len(keys), bool)
    exists[own[born]] = True
    wanted = refs["key"].to_numpy(str)
    at = np.searchsorted(keys, wanted)
    inside = at < len(keys)
    inside[inside] = keys[at[inside]] == wanted[inside]
    at = np.where(inside, at, -1)
    known = inside.copy()
    known[inside] = exists[at[inside]]
    # A reference without time is after nothing.
    timed = refs["time"].notna().to_numpy()
    time = np.where(timed, refs["time"].fillna(0).to_numpy(np.int64), FIRST_INSTANT - 1)
    scraped, present = _last_at_or_before(own[born], times[born], at, time)
    removed, withdrawn = _last_at_or_before(own[~born], times[~born], at, time)
    out = refs[["ref_table", "ref_key", "period"]].assign(document_id=refs["key"])
    if refs["blocks"].iloc[0] > 1:
        maybe = lambda values, there: pd.array(np.where(there, values, 0), dtype="Int64").copy()
        last, gone = maybe(scraped, present), maybe(removed, withdrawn)
        last[~present] = pd.NA
        gone[~withdrawn] = pd.NA
        return out.assign(time=refs["time"], reason=None, known=known, scraped=last, removed=gone)[columns]
    reason = np.where(~known, "missing", np.where(~present, "late", np.where(withdrawn & (removed >= scraped), "deleted", "")))
    # All rows of one reference are in this split, so this makes them distinct.
    out = out.assign(time=None, reason=reason, known=None, scraped=None, removed=None)[columns]
    return out[reason != ""].drop_duplicates()


def orphan_references(refs: DataFrame, parents: DataFrame, removals: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct orphan references, with the reason.

    ``refs``: ``ref_table, ref_key, key, time, period`` (``time`` in
    microseconds, null allowed); ``parents``: ``key, time`` of each appearance,
    ``FIRST_INSTANT`` where unreadable; ``removals``: ``key, time``.  Keys are
    compared as they are.

    A null key is no reference; ``missing`` if no parent has the key, ``late``
    if none appeared at or before the reference (a reference without time is
    ``late``), ``deleted`` if its last removal by then is not earlier than its
    last appearance by then.  Removals without time count as never.  Empty
    tables: without parents every reference is ``missing``, without references
    there are no rows.  Repeated rows change nothing.
    """
    held = parents.where("key is not null").select("key", "time", F.lit(True).alias("born"))
    gone = removals.where("key is not null and time is not null").select("key", "time", F.lit(False).alias("born"))
    # Repeated parents are dropped on the map side before they travel.
    both = held.unionByName(gone).dropDuplicates()
    refs = refs.where("key is not null").select("ref_table", "ref_key", "key", "time", "period")

    n_ranges = max(1, -(-held.count() // range_rows))
    # The upper 31 bits of the order, cut into n_ranges parts of equal width.
    in_range = F.shiftright(F.shiftrightunsigned(F.xxhash64("key"), 33) * n_ranges, 31).cast("int")
    refs, both = refs.withColumn("range", in_range), both.withColumn("range", in_range)

    # How many splits and blocks a range needs; one row per range.
    needed = lambda df, name: df.groupBy("range").agg(F.ceil(F.count("*") / range_rows).cast("int").alias(name))
    sizes = needed(refs, "splits").join(needed(both, "blocks"), "range", "left").select("range", "splits", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    split = F.pmod(F.xxhash64("ref_table", "ref_key"), F.col("splits")).cast("int").alias("split")
    block = F.pmod(F.xxhash64("key", "time", "born"), F.col("blocks")).cast("int").alias("block")
    left = refs.join(sizes, "range").select("range", split, every("blocks").alias("block"), "blocks", "ref_table", "ref_key", "key", "time", "period")
    right = both.join(sizes, "range").select("range", every("splits").alias("split"), block, "key", "time", "born")
    group = ("range", "split", "block")
    probed = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(_probe, _PROBED)
    one = probed.groupBy("ref_table", "ref_key", "document_id", "period", "time").agg(
        F.bool_or("known").alias("known"), F.max("scraped").alias("scraped"), F.max("removed").alias("removed"), F.collect_set("reason").alias("reasons")
    )
    judged = F.when(~F.col("known"), "missing").when(F.col("scraped").isNull(), "late").when(F.col("removed") >= F.col("scraped"), "deleted")
    # References of one period may be orphans for several reasons, at several times.
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array_compact(F.array(judged)))
    return one.select("ref_table", "ref_key", "document_id", "period", F.explode(reasons).alias("reason")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per referring table, month and reason."""
    return found.groupBy("ref_table", "period", "reason").agg(
        F.count("*").alias("orphans"), F.countDistinct("document_id").alias("documents")
    )
