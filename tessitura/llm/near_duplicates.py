"""Near-duplicate texts by banded signatures and sequential Bayesian verification.

1. Texts with the same words in the same order are one class.
2. Classes that agree in all rows of a band of min-hashes are candidates.
3. Candidates compare further one-bit min-hashes in batches of 64.  After each
   batch a pair is pruned if, given its matches so far and a uniform prior, the
   posterior probability of reaching the threshold is under ``miss``.
4. The survivors' word sequences are compared exactly.

No pair of copies is compared: copies meet as one class and are put back in at
the end.  A band value that many classes share is split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.session import materialize

#: A band has as many min-hashes as texts at the threshold agree in about this often; and the
#: probability that such a pair agrees in no band at all.
BAND_SHARE, BAND_MISS = 1 / 8, 0.005
BATCHES = 4
#: Classes of one band value that one task compares with one another.
HOT = 2_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are cut into words at once.
_CHUNK = 300_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def _in_word() -> np.ndarray:
    """By code point, whether it is a letter or digit."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


_factors = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number."""
    global _factors
    if len(_factors) < n:
        steps = np.full(max(n, 2 * len(_factors)), 0xD1342543DE82EF95, np.uint64)
        steps[0] = 1
        _factors = np.cumprod(steps)
    return _factors[:n]


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in lower case, in portions of bounded size; a long text is cut between words."""
    parts, owners, held = [], [], 0
    for owner, text in enumerate(texts):
        text, at = text.lower(), 0
        while at < len(text) or not text:
            end = min(at + _CHUNK, len(text))
            while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
                end += 1
            parts.append(text[at:end])
            owners.append(owner)
            held += end - at
            at = end
            if held >= _CHUNK:
                yield parts, owners
                parts, owners, held = [], [], 0
            if not text:
                break
    if parts:
        yield parts, owners


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Per text the 64-bit hashes of its words: unbroken runs of letters and digits, in lower case."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for parts, owners in _pieces(texts):
        codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _in_word()[codes]
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        length = np.diff(np.append(first, len(at)))
        place = np.arange(len(at)) - np.repeat(first, length)
        letters = _mixed(codes[at].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[place]
        words = _mixed(np.add.reduceat(letters, first) + length.astype(np.uint64))
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        bounds = np.searchsorted(at[first], starts)
        for i, owner in enumerate(owners):
            out[owner].append(words[bounds[i] : bounds[i + 1]])
    return [w[0] if len(w) == 1 else np.concatenate(w) if w else np.zeros(0, np.uint64) for w in out]


def sequence_hash(words: np.ndarray) -> int:
    """64-bit hash of words in order."""
    total = np.add.reduce(_mixed(words) * _powers(len(words) + 1)[1:]) + np.uint64(len(words))
    return int(_mixed(np.array([total], np.uint64)).view(np.int64)[0])


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the runs of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = words[:n]
    for i in range(1, size):
        run = _mixed(run) + words[i : i + n]
    return np.unique(_mixed(run))


def banding(threshold: float) -> tuple[int, int]:
    """Bands and min-hashes of each for a threshold: at 0.5 they are 40 and 3."""
    if not 0 < threshold <= 1:
        raise ValueError(f"the threshold must be above 0 and at most 1, got {threshold}")
    if threshold == 1:
        return 1, 3
    rows = max(1, round(np.log(BAND_SHARE) / np.log(threshold)))
    return int(np.ceil(np.log(BAND_MISS) / np.log1p(-(threshold**rows)))), rows


def _family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, count, dtype=np.uint32)[:, None], (rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1))[:, None]


def _min_hashes(items: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    flip, factor = family
    least = np.full(len(flip), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(items), 4096):
        hashed = items[None, at : at + 4096] ^ flip
        hashed *= factor
        np.minimum(least, hashed.min(axis=1), out=least)
    return least


def _signatures(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    family = _family(bands * rows + 64 * BATCHES, 7)
    number = np.arange(bands, dtype=np.uint64)
    for batch in batches:
        out = []
        for i, words in zip(batch.column(0).to_pylist(), word_hashes(batch.column(1).to_pylist())):
            items = shingle_set(words, size)
            if not len(items):
                continue
            least = _min_hashes((items >> np.uint64(32)).astype(np.uint32), family)
            value = number
            for r in range(rows):
                value = _mixed(value) + least[r * bands : (r + 1) * bands]
            bits = np.packbits(((least[bands * rows :] * np.uint32(0x85EBCA6B)) >> np.uint32(31)).astype(bool)).view(np.int64)
            out.append((i, sequence_hash(words), _mixed(value).view(np.int64), bits))
        ids, classes, values, bits = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.string()),
                pa.array(classes, pa.int64()),
                pa.ListArray.from_arrays(np.arange(0, bands * len(out) + 1, bands, dtype=np.int32), np.concatenate(values) if out else np.zeros(0, np.int64)),
                *(pa.array(np.array([b[k] for b in bits], np.int64)) for k in range(BATCHES)),
            ],
            names=["id", "cls", "bands", *(f"bits{k}" for k in range(BATCHES))],
        )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        classes, sets = [], []
        for words in word_hashes(batch.column(0).to_pylist()):
            items = shingle_set(words, size)
            if len(items):
                classes.append(sequence_hash(words))
                sets.append(items.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "items"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        similarity = np.zeros(batch.num_rows)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            similarity[i] = both / (len(x) + len(y) - both)
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity)], names=["a", "b", "similarity"])
        yield out.filter(pa.array(similarity >= threshold))


def least_matches(threshold: float, miss: float, batches: int = BATCHES) -> list[int]:
    """Per number of batches the fewest matching bits with which the posterior
    probability of a similarity of ``threshold`` or more is at least ``miss``.

    A bit matches with probability (1 + similarity) / 2; the prior is uniform.
    """
    p = (1 + (np.arange(20_000) + 0.5) / 20_000) / 2
    reached, out = p >= (1 + threshold) / 2, []
    for n in range(64, 64 * batches + 1, 64):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[reached].sum() >= miss * weight.sum():
                out.append(m)
                break
    return out


def _unlike(k: int):
    return F.bit_count(F.col(f"x.bits{k}").bitwiseXOR(F.col(f"y.bits{k}")))


def _candidates(classes: DataFrame, most_unlike: int) -> DataFrame:
    """Distinct class pairs that share a band and pass the first batch."""
    exploded = classes.select(F.explode("bands").alias("band"), "cls", "bits0")
    # Counted by a partial aggregation, then written: a hot value's rows never meet in a task to be counted, and AQE can split them below.
    sizes = materialize(exploded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    banded = exploded.join(sizes, "band")
    usual, hot = banded.where(f"n <= {HOT}"), banded.where(f"n > {HOT}")
    close = (F.col("x.cls") < F.col("y.cls")) & (_unlike(0) <= most_unlike)
    pairs = usual.alias("x").join(usual.alias("y"), (F.col("x.band") == F.col("y.band")) & close)
    parts = F.ceil(F.col("n") / HOT).cast("int")
    salted = hot.withColumn("part", F.pmod(F.hash("cls"), parts))
    spread = hot.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    hot_pairs = salted.alias("x").join(spread.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part")) & close)
    take = [F.col("x.cls").alias("a"), F.col("y.cls").alias("b")]
    return pairs.select(*take).unionByName(hot_pairs.select(*take)).distinct()


def near_duplicate_classes(
    df: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, shingle: int = 3, miss: float = 0.001,
    bands: int | None = None, rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Members (``cls, id``) and links between unlike classes (``a, b,
    similarity``) whose similarity is at least ``threshold``; links between
    classes of one and the same id are left out.  ``bands`` of ``rows``
    min-hashes follow the threshold where they aren't given (``banding``)."""
    usual = banding(threshold)
    bands, rows = bands or usual[0], rows or usual[1]
    texts = df.select(df[id_col].cast("string").alias("id"), df[text_col].alias("text")).where("id is not null and text is not null")
    kinds = ", ".join(f"bits{k} bigint" for k in range(BATCHES))
    signatures = materialize(texts.mapInArrow(lambda b: _signatures(b, shingle, bands, rows), f"id string, cls bigint, bands array<bigint>, {kinds}"), "signatures")
    members = signatures.select("cls", "id").distinct()
    least = least_matches(threshold, miss)

    own = F.xxhash64("id")
    single = signatures.groupBy("cls").agg(F.first("bands").alias("bands"), *(F.first(f"bits{k}").alias(f"bits{k}") for k in range(BATCHES)), F.min(own).alias("low"), F.max(own).alias("high"))
    classes = materialize(single, "classes")
    known = classes.drop("bands", "bits0")
    pairs = _candidates(classes.select("cls", "bands", "bits0"), 64 - least[0])
    pairs = pairs.join(known.alias("x"), F.col("a") == F.col("x.cls")).join(known.alias("y"), F.col("b") == F.col("y.cls"))
    one_id = (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))
    pairs = pairs.where(~one_id)
    unlike = F.lit(0)
    for k in range(1, BATCHES):
        unlike = unlike + _unlike(k)
        pairs = pairs.where(unlike <= 64 * k - least[k - 1])
    survivors = materialize(pairs.select("a", "b"), "survivors")

    wanted = survivors.select(F.col("a").alias("cls")).unionByName(survivors.select(F.col("b").alias("cls"))).distinct()
    sets = texts.select("text").mapInArrow(lambda b: _sets(b, shingle), "cls bigint, items binary")
    sets = sets.join(materialize(wanted, "wanted"), "cls", "left_semi").groupBy("cls").agg(F.first("items").alias("items"))
    left = survivors.join(sets.withColumnRenamed("items", "items_a"), F.col("a") == F.col("cls")).select("a", "b", "items_a")
    both = left.join(sets.withColumnsRenamed({"cls": "c", "items": "items_b"}), F.col("b") == F.col("c")).select("a", "b", "items_a", "items_b")
    links = both.mapInArrow(lambda b: _verify(b, threshold), "a bigint, b bigint, similarity double")
    return members, links


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, **settings) -> DataFrame:
    """Distinct ``id_a < id_b`` with a row each whose texts are alike.

    Similarity: distinct runs of ``shingle`` words found in both texts, divided
    by those found in either.  Null texts and ids, and texts of fewer words
    than ``shingle``, are like nothing; repeated rows change nothing; an id is
    no partner of itself; an empty table gives no rows.
    """
    members, links = near_duplicate_classes(df, id_col, text_col, **settings)
    x, y = members.select(F.col("cls").alias("a"), F.col("id").alias("id_x")), members.select(F.col("cls").alias("b"), F.col("id").alias("id_y"))
    between = links.select("a", "b").join(x, "a").join(y, "b").where("id_x <> id_y")
    within = x.join(y, F.col("a") == F.col("b")).where("id_x < id_y")
    take = [F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")]
    return between.select(*take).unionByName(within.select(*take)).distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that can be reached.

    Every round each node takes the smallest label of its neighbours, then the
    label of its label; written to the shared folder each round. The rounds end
    when no label changes.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        better = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        moved = materialize(
            better.join(jump, F.col("next") == F.col("at"), "left").select("node", "old", F.least("next", "further").alias("component")), "labels"
        )
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, **settings) -> DataFrame:
    """One row per id that has text: ``id_col``, ``group_id`` (the smallest id
    of its group) and ``links``, its number of links to unlike classes."""
    members, links = near_duplicate_classes(df, id_col, text_col, **settings)
    members, links = materialize(members, "members"), materialize(links, "links")
    # Ids and classes are the nodes of one graph: an id joins its classes.
    tagged = members.select(F.concat(F.lit("i"), "id").alias("a"), F.concat(F.lit("t"), F.col("cls").cast("string")).alias("b"))
    linked = links.select(F.concat(F.lit("t"), F.col("a").cast("string")).alias("a"), F.concat(F.lit("t"), F.col("b").cast("string")).alias("b"))
    edges = tagged.unionByName(linked)
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    found = components(edges, nodes).where("startswith(node, 'i')").select(F.substring("node", 2, 1 << 30).alias("id"), F.substring("component", 2, 1 << 30).alias("group_id"))
    degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n"))
    per_id = members.join(degree, "cls").groupBy("id").agg(F.sum("n").alias("links"))
    # Texts too short for a run of words are like nothing: groups of their own.
    ids = df.select(df[id_col].cast("string").alias("id"), df[text_col].alias("text")).where("id is not null and text is not null").select("id").distinct()
    every = ids.join(found, "id", "left").join(per_id, "id", "left")
    return every.select(F.col("id").alias(id_col), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
