"""Filling containers of fixed capacity: minimum bin slack by windows.

Items lie in shards of bounded size.  Within a shard only the multiset of
lengths matters: each window starts with the longest length left, a bitset
subset-sum over the remaining lengths finds the sum closest to the capacity,
backtracking through the kept bitsets gives how many of each length it takes,
and the pattern is repeated as often as the counts allow.  Of its containers
that stay partly empty a shard opens the emptiest again, up to an eighth of its
items; those of ``FAN_IN`` shards are one shard of the next level.  So no shard
of any level is larger than the first ones, however the lengths are mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.encoding import TOKENIZER_DIR, count_tokens
from tessitura.session import materialize

#: Items that one shard holds on average, and shards whose open items make one of the next level.
SHARD_ITEMS, FAN_IN = 8_192, 8
#: Tasks of a level at most; beyond, a task packs several shards, one by one.
MOST_TASKS = 20_000


def best_window(room: int, lengths: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """(length, how many) of the multiset whose sum is closest to ``room`` and
    not above it. ``lengths`` descend."""
    full, mask = 1 << room, (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, count in zip(lengths, counts):
        if length > room:
            continue
        left, chunk = min(count, room // length), 1
        while left:
            take = min(chunk, left)
            grown = (reach | reach << take * length) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            chunk *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return list(used.items())


def patterns(histogram: dict[int, int], capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Window patterns and how often each is repeated, until no length is left."""
    left = {k: v for k, v in histogram.items() if v}
    while left:
        lengths = sorted(left, reverse=True)
        seed = lengths[0]
        left[seed] -= 1
        rest = best_window(capacity - seed, lengths, [left[x] for x in lengths])
        left[seed] += 1
        used = dict(rest)
        used[seed] = used.get(seed, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        yield list(used.items()), times


def _pack_shard(rows: pd.DataFrame, capacity: int, reopened: int) -> pd.DataFrame:
    """The rows with their container in the shard and whether it is opened
    again: the emptiest that aren't full, as long as they hold ``reopened``
    items together, but at least one."""
    rows = rows.sort_values(["n_tokens", "item", "piece"], kind="stable")
    sizes = rows["n_tokens"].to_numpy()
    lengths, starts, counts = np.unique(sizes, return_index=True, return_counts=True)
    at = dict(zip(lengths.tolist(), starts.tolist()))
    bins, n_bins, fills, held = np.zeros(len(rows), np.int64), 0, [], []
    for used, times in patterns(dict(zip(lengths.tolist(), counts.tolist())), capacity):
        for x, n in used:
            bins[at[x] : at[x] + n * times] = n_bins + np.repeat(np.arange(times), n)
            at[x] += n * times
        fills.append(np.full(times, sum(x * n for x, n in used)))
        held.append(np.full(times, sum(n for _, n in used)))
        n_bins += times
    fill, items = np.concatenate(fills), np.concatenate(held)
    order = np.argsort(fill, kind="stable")
    again = np.zeros(n_bins, bool)
    again[order] = (fill[order] < capacity) & ((np.cumsum(items[order]) <= reopened) | (np.arange(n_bins) == 0))
    return rows.assign(bin=bins, again=again[bins] & (reopened > 0))


def _packer(capacity: int, reopened: int):
    return lambda rows: _pack_shard(rows, capacity, reopened)


def fill_containers(sizes: DataFrame, id_col: str, capacity: int = 2048, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assign every item of ``sizes`` (``id_col``, ``n_tokens``) to containers.

    Returns ``id_col, piece int, token_start int, n_tokens int, container_id
    string``; an item larger than ``capacity`` is split into full containers
    and one remainder, no other item is split.  Items without tokens, or with
    a null size, need no room and are left out; repeated rows are items of
    their own; an empty table gives no rows.
    """
    kind = sizes.schema[id_col].dataType.simpleString()
    whole = F.expr(f"cast(n_tokens div {capacity} as int)")
    pieces = (
        sizes.where("n_tokens > 0")
        .select(
            F.col(id_col).alias("item"),
            F.col("n_tokens").alias("size"),
            F.explode(F.sequence(F.lit(0), F.when(F.col("n_tokens") % capacity == 0, whole - 1).otherwise(whole))).alias("piece"),
        )
        .select("item", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).alias("n_tokens"))
    )
    full = pieces.where(f"n_tokens = {capacity}").select("item", "piece", "n_tokens", F.concat_ws("-", F.lit("full"), F.col("item").cast("string"), F.col("piece"), F.monotonically_increasing_id()).alias("container_id"))
    open_ = pieces.where(f"n_tokens < {capacity}")
    shards = max(1, -(-open_.count() // shard_items))
    # A shard number is given to each row on its own, so that repeated ids don't gather.
    open_ = open_.withColumn("shard", F.pmod(F.xxhash64("item", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    done, level = full, 0
    while True:
        last = shards == 1
        # Partitioned by shard with as many tasks: small shards aren't put into one.
        placed = open_.repartition(min(shards, MOST_TASKS), "shard")
        pack = _packer(capacity, 0 if last else max(1, shard_items // FAN_IN))
        packed = placed.groupBy("shard").applyInPandas(pack, f"item {kind}, piece int, n_tokens int, shard int, bin bigint, again boolean")
        named = F.concat_ws("-", F.lit(level).cast("string"), "shard", "bin").alias("container_id")
        if last:
            done = done.unionByName(packed.select("item", "piece", "n_tokens", named))
            break
        packed = materialize(packed, "containers")
        done = done.unionByName(packed.where("not again").select("item", "piece", "n_tokens", named))
        shards = -(-shards // FAN_IN)
        open_ = packed.where("again").select("item", "piece", "n_tokens", (F.col("shard") % shards).alias("shard"))
        level += 1
    return done.select(
        F.col("item").alias(id_col), "piece", (F.col("piece") * capacity).alias("token_start"), F.col("n_tokens").cast("int"), "container_id"
    )


def pack_documents(
    df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """Containers for the texts of ``df``, sized in tokens of ``vocabulary``."""
    sizes = materialize(count_tokens(df, id_col, text_col, vocabulary, tokenizer_dir), "sizes")
    return fill_containers(sizes, id_col, capacity)


def container_report(assigned: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers, tokens and unused share of an assignment, one row."""
    each = assigned.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return each.agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count("*") * F.lit(capacity)), 6).alias("unused_share"),
    )
