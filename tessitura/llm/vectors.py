"""Most similar vectors for every vector, by learned partitions.

On a bounded sample of each collection a graph of nearest neighbours is built
and cut into balanced parts; a softmax classifier learns the part of a vector.
It routes every vector of the collection to its most probable part, where it is
indexed, and as a query to every part that is probable enough.  Within a part
all queries meet all indexed vectors in one matrix product in double precision;
the best of all parts are merged.  A part that holds far more vectors than it
should, because the collection wants more parts than one router has, is divided
again: tasks fit a router on a bounded sample of each such part, its vectors are
routed on, and so forth until parts are small or don't divide.  A part that
stays too large for one task is cut into blocks, and its queries, cut into
shards, visit them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.session import materialize

#: Vectors a part holds on average, and at most in a block or a shard of queries.
PART_ROWS, BLOCK_ROWS = 2_500, 8_192
#: Parts of one router, and how many times ``part_rows`` a part must hold to be divided again.
FAN_OUT, DIVIDED = 256, 4
#: Rows of a batch that goes to the cells, and visits that one task routes on.
BATCH_ROWS, ROUTED_ROWS = 16_384, 100_000
#: Vectors per part in the sample a router is fitted on: ``FAN_OUT`` times as many at most.
SAMPLE_PER_PART = 160
#: A query visits parts of at least this probability, ``LEAST_PROBES`` to ``MOST_PROBES`` of each router.
LEAST_PROBABILITY, LEAST_PROBES, MOST_PROBES = 0.004, 1, 8
#: Buckets of the hash that draws samples.
_BUCKETS = 1 << 40


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """The ``k`` nearest others of each row of unit vectors."""
    k = min(k, len(x) - 1)
    near = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024].astype(np.float32) @ x.T.astype(np.float32)
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        near[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.15, seed: int = 3) -> np.ndarray:
    """Cut the graph into ``parts`` of at most ``slack`` times the mean size.

    Spherical k-means gives the start; then nodes move to the part that holds
    most of their neighbours, as long as it has room.
    """
    n, rng = len(x), np.random.default_rng(seed)
    room = int(np.ceil(slack * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(12):
        part = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = norms[:, 0] < 1e-9
        centres = np.where(empty[:, None], x[rng.choice(n, parts)], sums / np.maximum(norms, 1e-9))
    score = x @ centres.T
    order = np.argsort(-score.max(axis=1), kind="stable")
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    for i in order:
        for p in np.argsort(-score[i], kind="stable"):
            if size[p] < room:
                part[i] = p
                size[p] += 1
                break
    for _ in range(5):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[near[i]], minlength=parts)
            best = int(np.argmax(votes))
            if best != part[i] and votes[best] > votes[part[i]] and size[best] < room:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, part: np.ndarray, near: np.ndarray, parts: int, rounds: int = 80, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression, fitted by Adam on the whole sample.

    A vector's target is the spread of its neighbours over the parts, with
    itself counted for as many: the probability of a part is then about the
    share of a query's neighbours to be found there.
    """
    x = x.astype(np.float32)
    target = np.zeros((len(x), parts), np.float32)
    target[np.arange(len(x)), part] = near.shape[1]
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
    target /= target.sum(axis=1, keepdims=True)
    w, b = np.zeros((x.shape[1], parts), np.float32), np.zeros(parts, np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        p = np.exp((z := x @ w + b) - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) / np.float32(len(x))
        for j, (value, gradient) in enumerate(((w, x.T @ error), (b, error.sum(axis=0)))):
            first, second = moments[2 * j], moments[2 * j + 1]
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            value -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-10)
    return w.astype(np.float64), b.astype(np.float64)


def route(x: np.ndarray, router: tuple[np.ndarray, np.ndarray], least: np.ndarray | float = LEAST_PROBABILITY, most_probes: int = MOST_PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts by falling probability (``most_probes`` at most), which of them are visited, and their probabilities."""
    w, b = router
    logits = x @ w + b
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    top = np.argpartition(-p, most_probes - 1, axis=1)[:, :most_probes] if most_probes < p.shape[1] else np.tile(np.arange(p.shape[1]), (len(p), 1))
    held = np.take_along_axis(p, top, axis=1)
    order = np.lexsort((top, -held), axis=1)
    top, held = np.take_along_axis(top, order, axis=1), np.take_along_axis(held, order, axis=1)
    visited = held >= np.reshape(least, (-1, 1))
    visited[:, :LEAST_PROBES] = True
    return top, visited, held


def fit_parts(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Router of ``parts`` balanced parts for a sample of unit vectors; one part
    if the sample has no more vectors than that."""
    if parts < 2 or len(x) <= parts:
        return np.zeros((x.shape[1], 1)), np.zeros(1)
    near = neighbour_graph(x)
    return fit_router(x, balanced_parts(x, near, parts), near, parts)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _counted(batches: Iterator[pa.RecordBatch], routers: dict, least: float, most_probes: int) -> Iterator[pa.RecordBatch]:
    """How many vectors of each batch are indexed in a part, and how many visit it."""
    for batch in batches:
        models = batch.column(0).to_pylist()
        for model in set(models):
            own = batch.filter(pa.array([m == model for m in models]))
            top, visited, _ = route(_unit(_matrix(own.column(2), len(routers[model][0]))), routers[model], least, most_probes)
            parts = routers[model][0].shape[1]
            n, visits = np.bincount(top[:, 0], minlength=parts), np.bincount(top[visited], minlength=parts)
            seen = np.flatnonzero(visits)
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen]), pa.array(visits[seen])], names=["model", "part", "n", "visits"])


def _routed(batches: Iterator[pa.RecordBatch], routers: dict, cells: dict, least: float, most_probes: int) -> Iterator[pa.RecordBatch]:
    """A row for each cell (part, block, shard) that a vector is in: as a query
    in its shard with all blocks of the parts it visits, indexed in its block
    with all shards. ``cells`` holds the blocks and shards of each part; parts
    without blocks are divided further and left out here."""
    for batch in batches:
        models = batch.column(0).to_pylist()
        for model in set(models):
            own = batch.filter(pa.array([m == model for m in models]))
            top, visited, _ = route(_unit(_matrix(own.column(2), len(routers[model][0]))), routers[model], least, most_probes)
            blocks, shards = (np.array(c) for c in cells[model])
            hashed = np.array([xxhash.xxh3_64_intdigest(c) for c in own.column(1).to_pylist()], np.uint64)
            home = (hashed % np.maximum(1, blocks[top[:, 0]]).astype(np.uint64)).astype(np.int64)
            rows, probes = np.nonzero(visited & (blocks[top] > 0))
            if not len(rows):
                continue
            repeats = blocks[top[rows, probes]] + np.where(probes == 0, shards[top[rows, probes]] - 1, 0)
            pieces = np.flatnonzero(np.diff(np.cumsum(repeats) // BATCH_ROWS)) + 1
            for row, probe, repeat in zip(*(np.split(x, pieces) for x in (rows, probes, repeats))):
                at = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                row, probe = np.repeat(row, repeat), np.repeat(probe, repeat)
                part = top[row, probe]
                # First its blocks as a query, then the other shards of its own block.
                asks = at < blocks[part]
                block = np.where(asks, at, home[row])
                shard = (hashed[row] % shards[part].astype(np.uint64)).astype(np.int64)
                shard = np.where(asks, shard, (shard + 1 + at - blocks[part]) % shards[part])
                indexed = (probe == 0) & (block == home[row])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(take), pa.array(part.astype(np.int64) + 1), *(pa.array(x.astype(np.int32)) for x in (block, shard)), pa.array(indexed), pa.array(asks), own.column(1).take(take), own.column(2).take(take)],
                    names=["model", "part", "block", "shard", "indexed", "asks", "item", "vector"],
                )


def _visits(batches: Iterator[pa.RecordBatch], routers: dict, divided: dict, least: float, most_probes: int) -> Iterator[pa.RecordBatch]:
    """The visits to parts that are divided further, with their probabilities; ``home`` is the part that indexes the vector."""
    for batch in batches:
        models = batch.column(0).to_pylist()
        for model in set(models) & set(divided):
            own = batch.filter(pa.array([m == model for m in models]))
            top, visited, p = route(_unit(_matrix(own.column(2), len(routers[model][0]))), routers[model], least, most_probes)
            rows, probes = np.nonzero(visited & np.isin(top, divided[model]))
            for at in range(0, len(rows), BATCH_ROWS):
                row, probe = rows[at : at + BATCH_ROWS], probes[at : at + BATCH_ROWS]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(take), pa.array(top[row, probe].astype(np.int64) + 1), pa.array(p[row, probe]), pa.array(probe == 0), own.column(1).take(take), own.column(2).take(take)],
                    names=["model", "part", "p", "home", "item", "vector"],
                )


_VISITS = "model string, part bigint, p double, home boolean, item string, vector array<float>"


def _fit_part(sample: pa.Table, part_rows: int, fan_out: int) -> pa.Table:
    """The router of one part, from its sample (``model, part, n, vector``)."""
    first = sample.slice(0, 1)
    dim = len(first.column("vector")[0])
    x = _unit(_matrix(sample.column("vector").combine_chunks(), dim))
    w, b = fit_parts(x, min(fan_out, -(-first.column("n")[0].as_py() // part_rows)))
    return pa.table({"model": first.column("model"), "part": first.column("part"), "router": pa.array([np.vstack([w, b]).tobytes()], pa.binary()), "parts": pa.array([len(b)], pa.int32())})


def _route_on(visits: pa.Table, routers: pa.Table, least: float, most_probes: int) -> pa.Table:
    """Visits to a part as visits to the parts it is divided into."""
    schema = pa.schema([("model", pa.string()), ("part", pa.int64()), ("p", pa.float64()), ("home", pa.bool_()), ("item", pa.string()), ("vector", pa.list_(pa.float32()))])
    if not visits.num_rows or not routers.num_rows:
        return schema.empty_table()
    visits = visits.combine_chunks()
    parts = routers.column("parts")[0].as_py()
    held = np.frombuffer(routers.column("router")[0].as_buffer()).reshape(-1, parts)
    before, home = visits.column("p").to_numpy(), visits.column("home").to_numpy(zero_copy_only=False)
    vectors = visits.column("vector").combine_chunks()
    # Of the whole way down the probability is the product.
    top, visited, p = route(_unit(_matrix(vectors, len(held) - 1)), (held[:-1], held[-1]), least / np.maximum(before, 1e-300), most_probes)
    row, probe = np.nonzero(visited)
    part = visits.column("part")[0].as_py() * (FAN_OUT + 1) + top[row, probe] + 1
    take = pa.array(row)
    return pa.table(
        [visits.column("model").take(take), pa.array(part.astype(np.int64)), pa.array(before[row] * p[row, probe]), pa.array(home[row] & (probe == 0)), visits.column("item").take(take), vectors.take(take)],
        schema=schema,
    )


def _sizes(visits: DataFrame) -> DataFrame:
    return visits.groupBy("model", "part").agg(F.count_if("home").alias("n"), F.count("*").alias("visits"))


def _divide(visits: DataFrame, part_rows: int, fan_out: int, least: float, most_probes: int) -> DataFrame:
    """Cells of the visits to parts that are too large, divided level by level.
    The routers are fitted in tasks, one per part, and never collected."""
    leaves, visits = [], materialize(visits, "visits")
    sizes = materialize(_sizes(visits).withColumn("divide", F.lit(True)), "parts")
    while True:
        large = sizes.where("divide").select("model", "part", "n", "visits")
        share = F.least(F.lit(1.0), F.lit(1.05 * SAMPLE_PER_PART * min(fan_out, FAN_OUT)) / F.col("n"))
        drawn = visits.where("home").join(large, ["model", "part"]).where(F.pmod(F.xxhash64("part", "item"), F.lit(_BUCKETS)) < share * _BUCKETS)
        fit = drawn.select("model", "part", "n", "vector").groupBy("model", "part").applyInArrow(lambda t: _fit_part(t, part_rows, fan_out), "model string, part bigint, router binary, parts int")
        fit = materialize(fit.where("parts > 1"), "routers")
        shards = F.ceil(F.col("visits") / ROUTED_ROWS).cast("int")
        routers = large.join(fit, ["model", "part"]).select("model", "part", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), "router", "parts")
        own = visits.join(large.join(fit.select("model", "part"), ["model", "part"]), ["model", "part"]).withColumn("shard", F.pmod(F.xxhash64("item"), shards).cast("int"))
        keys = ("model", "part", "shard")
        routed = own.groupBy(*keys).cogroup(routers.groupBy(*keys)).applyInArrow(lambda v, r: _route_on(v, r, least, most_probes), _VISITS)
        on = materialize(routed, "visits")
        # Parts that were small, or whose sample didn't divide, are done.
        done = sizes.join(fit.select("model", "part", "parts"), ["model", "part"], "left_anti").select("model", "part", "n", "visits")
        leaves.append(visits.join(done, ["model", "part"]))
        # A part that took nearly all of its parent doesn't divide further; nor do parts too deep for their numbers.
        parent = sizes.select("model", F.col("part").alias("parent"), F.col("n").alias("above"))
        found = _sizes(on).withColumn("parent", F.expr(f"part div {FAN_OUT + 1}")).join(parent, ["model", "parent"])
        divide = (F.col("n") >= DIVIDED * part_rows) & (F.col("n") < 0.9 * F.col("above")) & (F.col("part") < (1 << 62) // (FAN_OUT + 1))
        visits, sizes = on, materialize(found.select("model", "part", "n", "visits", divide.alias("divide")), "parts")
        if sizes.where("divide").isEmpty():
            leaves.append(visits.join(sizes.select("model", "part", "n", "visits"), ["model", "part"]))
            break
    each = leaves[0]
    for other in leaves[1:]:
        each = each.unionByName(other)
    blocks, queries = (F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_ROWS)).cast("int") for c in ("n", "visits"))
    placed = each.withColumn("blocks", blocks).withColumn("shards", queries)
    placed = placed.withColumn("own_block", F.pmod(F.xxhash64("item"), "blocks").cast("int")).withColumn("own_shard", F.pmod(F.hash("item"), "shards"))
    asking = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = asking.select("model", "part", "block", F.col("own_shard").alias("shard"), (F.col("home") & (F.col("block") == F.col("own_block"))).alias("indexed"), F.lit(True).alias("asks"), "item", "vector")
    held = placed.where("home").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("shard <> own_shard")
    held = held.select("model", "part", F.col("own_block").alias("block"), "shard", F.lit(True).alias("indexed"), F.lit(False).alias("asks"), "item", "vector")
    return asking.unionByName(held)


def _search(cell: pa.Table, k: int, dims: dict) -> pa.Table:
    cell = cell.combine_chunks()
    model = cell.column("model")[0].as_py()
    dim = dims[model]
    items = cell.column("item").to_numpy(zero_copy_only=False).astype(str)
    indexed, asks = (cell.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("indexed", "asks"))
    # Each item once, as an indexed row if it has one; in the order that ties follow.
    order = np.lexsort((~indexed, items))
    order = order[np.concatenate([[True], items[order][1:] != items[order][:-1]])] if len(order) else order
    items, indexed, asks = items[order], indexed[order], asks[order]
    x = _unit(_matrix(cell.column("vector").take(pa.array(order)).combine_chunks(), dim))
    held, queries = np.flatnonzero(indexed), np.flatnonzero(asks)
    schema = pa.schema([("model", pa.string()), ("item", pa.string()), ("near", pa.list_(pa.struct([("far", pa.float64()), ("item", pa.string())])))])
    if not len(held) or not len(queries):
        return schema.empty_table()
    # Of equal vectors the first k + 1 are enough for any query.
    _, same = np.unique(x[held], axis=0, return_inverse=True)
    by_value = np.argsort(same.ravel(), kind="stable")
    sorted_same = same.ravel()[by_value]
    rank = np.arange(len(by_value)) - np.searchsorted(sorted_same, sorted_same)
    held = held[np.sort(by_value[rank <= k])]
    position = np.full(len(items), -1)
    position[held] = np.arange(len(held))
    base, want = x[held], min(len(held), k + 8)
    ends, far, near = [0], [], []
    for at in range(0, len(queries), 1024):
        s = x[queries[at : at + 1024]] @ base.T
        own = position[queries[at : at + 1024]]
        s[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
        best = np.argpartition(-s, want - 1, axis=1)[:, :want]
        value = np.round(np.take_along_axis(s, best, axis=1), 12)
        rows = np.argsort(best, axis=1)
        best, value = np.take_along_axis(best, rows, axis=1), np.take_along_axis(value, rows, axis=1)
        rows = np.argsort(-value, axis=1, kind="stable")
        best, value = np.take_along_axis(best, rows, axis=1), np.take_along_axis(value, rows, axis=1)
        tied = np.flatnonzero(value[:, -1] >= value[:, min(k, want) - 1]) if want < len(held) else []
        for i in tied:  # ties reach beyond the candidates: look at the whole row
            whole = np.round(s[i], 12)
            best[i] = np.argsort(-whole, kind="stable")[:want]
            value[i] = whole[best[i]]
        good = np.isfinite(value[:, :k])
        ends.extend((ends[-1] + np.cumsum(good.sum(axis=1))).tolist())
        far.append(-value[:, :k][good])
        near.append(held[best[:, :k][good]])
    found = pa.StructArray.from_arrays([pa.array(np.concatenate(far)), pa.array(items[np.concatenate(near)], pa.string())], names=["far", "item"])
    lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), found)
    return pa.Table.from_arrays([pa.array([model] * len(queries), pa.string()), pa.array(items[queries], pa.string()), lists], schema=schema)


def usable_vectors(df: DataFrame, item_col: str, model_col: str, vector_col: str, time_col: str | None = None) -> DataFrame:
    """``model, item, vector`` of the rows that take part: the vector has the
    length that ends the name of its model, no null, NaN or infinite entry and
    not zeros only. An item with several unlike vectors keeps the last one by
    ``time_col`` (the one of the larger hash on ties)."""
    v, dim = F.col("vector"), F.regexp_extract("model", r"(\d+)$", 1).try_cast("int")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(
        df[model_col].alias("model"), df[item_col].alias("item"), df[vector_col].cast("array<float>").alias("vector"),
        (df[time_col] if time_col else F.lit(None).cast("timestamp")).alias("time"),
    )
    rows = rows.where(F.col("item").isNotNull() & (F.size(v) == dim) & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0))
    mark = F.struct(F.col("time"), F.xxhash64("vector").alias("hash"))
    keys = rows.groupBy("model", "item").agg(F.min(F.xxhash64("vector")).alias("low"), F.max(F.xxhash64("vector")).alias("high"), F.max(mark).alias("last"))
    unlike = materialize(keys.where("low <> high").select("model", "item", F.col("last.hash").alias("kept")), "unlike")
    if not unlike.isEmpty():
        rows = rows.join(unlike, ["model", "item"], "left").where(F.col("kept").isNull() | (F.col("kept") == F.xxhash64("vector")))
    return rows.select("model", "item", "vector")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors of a model are one class: its representatives (``model,
    item, vector``, the smallest item), and the members of those with several
    (``model, rep, item``). However many copies a vector has, it is searched once."""
    value = F.xxhash64("vector").alias("value")
    each = rows.groupBy("model", value).agg(F.min("item").alias("item"), F.max("item").alias("last"), F.first("vector").alias("vector"))
    each = materialize(each, "vectors")
    several = each.where("item <> last").select("model", "value", F.col("item").alias("rep"))
    members = rows.select("model", "item", value).join(several, ["model", "value"]).select("model", "rep", "item").distinct()
    return each.select("model", "item", "vector"), materialize(members, "copies")


def _with_copies(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Neighbour lists of representatives, made lists of all items: in place of
    a class stand its ``k`` + 1 smallest members, and its own are neighbours too."""
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("model", "rep").orderBy("item"))).where(F.col("r") <= k + 1)
    held = materialize(first.groupBy(F.col("model").alias("m"), F.col("rep").alias("n")).agg(F.sort_array(F.collect_list("item")).alias("held")), "held")
    own = F.array(F.struct(F.lit(-1.0).alias("far"), F.col("item").alias("item")))
    each = near.select("model", "item", F.explode(F.concat("near", own)).alias("x")).select("model", "item", "x.far", F.col("x.item").alias("other"))
    each = each.join(held, (F.col("model") == F.col("m")) & (F.col("other") == F.col("n")), "left")
    listed = F.transform(F.coalesce("held", F.array("other")), lambda i: F.struct(F.col("far").alias("far"), i.alias("item")))
    # Still partitioned by model and item: no further shuffle.
    lists = each.select("model", "item", listed.alias("near")).groupBy("model", "item").agg(F.flatten(F.collect_list("near")).alias("near"))
    # Read twice below, searched once.
    lists = materialize(lists.select("model", "item", F.slice(F.array_sort("near"), 1, k + 1).alias("near")), "near")
    single = lists.join(members.select("model", F.col("rep").alias("item")).distinct(), ["model", "item"], "left_anti")
    several = members.join(lists.withColumnRenamed("item", "rep"), ["model", "rep"]).select("model", "item", "near")
    both = single.unionByName(several)
    return both.select("model", "item", F.slice(F.filter("near", lambda x: x["item"] != F.col("item")), 1, k).alias("near"))


def most_similar(
    df: DataFrame, item_col: str, model_col: str, vector_col: str, time_col: str | None = None, k: int = 5, part_rows: int = PART_ROWS, fan_out: int = FAN_OUT,
    least_probability: float = LEAST_PROBABILITY, most_probes: int = MOST_PROBES, exact: bool = False,
) -> DataFrame:
    """``model, item, near``: for each item its ``k`` most similar others of
    the same model as ``array<struct<far double, item string>>``, nearest
    first; ``far`` is minus the cosine, rounded to 12 decimals; ties go to the
    smaller item.

    A query visits the parts of at least ``least_probability``, ``most_probes``
    of each router at most; more of them, or larger parts (``part_rows``), find
    more.  ``exact`` has no parts: every block of queries meets every block of
    vectors.

    Vectors that are null, of another length, zero or not finite take no part;
    repeated items count once; a model with one item gives it an empty list; an
    empty table gives no rows.
    """
    if not 2 <= fan_out <= FAN_OUT:
        raise ValueError(f"fan_out must be 2 to {FAN_OUT}, got {fan_out}")
    rows, members = _classes(usable_vectors(df, item_col, model_col, vector_col, time_col))
    counts = {r["model"]: r["n"] for r in rows.groupBy("model").agg(F.count("*").alias("n")).collect()}
    routers, dims = {}, {}
    for model, n in counts.items():
        parts = 1 if exact else min(fan_out, -(-n // part_rows))
        own = rows.where(F.col("model") == model)
        dims[model] = len(own.first()["vector"])
        routers[model] = (np.zeros((dims[model], 1)), np.zeros(1))
        if parts > 1:
            share = min(1.0, 1.05 * max(2_048, SAMPLE_PER_PART * parts) / n)
            drawn = own.where(F.pmod(F.xxhash64("item"), F.lit(_BUCKETS)) < int(share * _BUCKETS))
            # A bounded sample: SAMPLE_PER_PART x FAN_OUT rows, about.
            x = drawn.select("vector").toPandas()["vector"]
            routers[model] = fit_parts(_unit(np.stack(x.tolist())), parts) if len(x) else routers[model]
    counted = rows.mapInArrow(lambda b: _counted(b, routers, least_probability, most_probes), "model string, part int, n long, visits long").groupBy("model", "part").agg(F.sum("n").alias("n"), F.sum("visits").alias("visits"))
    cells = {m: ([1] * routers[m][0].shape[1], [1] * routers[m][0].shape[1]) for m in routers}
    divided: dict[str, list[int]] = {}
    for r in counted.collect():  # one row per part
        for held, n in zip(cells[r["model"]], (r["n"], r["visits"])):
            held[r["part"]] = max(1, -(-n // BLOCK_ROWS))
        # Only a router that has all its parts can hold parts that want to be several.
        if len(cells[r["model"]][0]) == fan_out and r["n"] >= DIVIDED * part_rows:
            divided.setdefault(r["model"], []).append(r["part"])
            cells[r["model"]][0][r["part"]] = 0
    visits = rows.mapInArrow(lambda b: _routed(b, routers, cells, least_probability, most_probes), "model string, part bigint, block int, shard int, indexed boolean, asks boolean, item string, vector array<float>")
    if divided:
        large = rows.mapInArrow(lambda b: _visits(b, routers, divided, least_probability, most_probes), _VISITS)
        visits = visits.unionByName(_divide(large, part_rows, fan_out, least_probability, most_probes))
    found = visits.groupBy("model", "part", "block", "shard").applyInArrow(lambda cell: _search(cell, k, dims), "model string, item string, near array<struct<far double, item string>>")
    merged = found.groupBy("model", "item").agg(F.flatten(F.collect_list("near")).alias("near"))
    near = merged.select("model", "item", F.slice(F.array_sort(F.array_distinct("near")), 1, k).alias("near"))
    return near if members.isEmpty() else _with_copies(near, members, k)


def similar_pairs(df: DataFrame, item_col: str, model_col: str, vector_col: str, time_col: str | None = None, k: int = 5, **settings) -> DataFrame:
    """Distinct ``item_a < item_b`` of which one is among the other's ``k`` most similar."""
    each = most_similar(df, item_col, model_col, vector_col, time_col, k, **settings).select("item", F.explode("near.item").alias("other"))
    return each.select(F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b")).distinct()
