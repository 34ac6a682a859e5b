"""Collected documents: merging, gaps, checks and catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions.keys import strip
from tessitura.functions.times import instant_micros
from tessitura.schemas import DOCUMENT_KEY, DOCUMENT_REQUIRED, METHODS, MIN_TEXT
from tessitura.session import materialize


def latest_per_key(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each key by ``order`` (which should end in a unique column)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_of_few(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The same for a key of which few rows are repeats: only those are shuffled with their columns."""
    repeated = materialize(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit(True).alias("_more")), "repeated")
    marked = df.join(repeated, key, "left")
    single = marked.where("_more is null").drop("_more")
    return single.unionByName(latest_per_key(marked.where("_more").drop("_more"), (key,), *order))


def upsert(current: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = DOCUMENT_KEY, tie: str = "registro") -> DataFrame:
    """Union in which the row last scraped wins; an unreadable time precedes
    every other, on equal times the incoming row wins, then the larger ``tie``."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, instant_micros(F.col("scraped_at")).desc(), F.desc("_new"), F.desc(tie)).drop("_new")


def missing_methods(docs: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """``id, metodo_extracao`` of every extraction that a document lacks."""
    wanted = F.array(*map(F.lit, methods))
    have = docs.where("id is not null").groupBy("id").agg(F.collect_set("metodo_extracao").alias("have"))
    return have.select("id", F.explode(F.array_except(wanted, "have")).alias("metodo_extracao"))


def document_violations(docs: DataFrame, required: tuple[str, ...] = DOCUMENT_REQUIRED) -> DataFrame:
    """``rule, rows`` of the schema gate; a rule without violation has 0."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in required]
    counts.append(F.count_if(F.length("texto") < MIN_TEXT).alias("short:texto"))
    counts.append(F.count_if(~F.col("metodo_extracao").isin(*METHODS)).alias("enum:metodo_extracao"))
    single = docs.agg(*counts)
    names = single.columns
    rules = single.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("rows")) for n in names))).alias("r")).select("r.*")
    extra = docs.groupBy(*DOCUMENT_KEY).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows")).select(F.lit("duplicate:id+metodo").alias("rule"), "rows")
    return rules.unionByName(extra)


def in_force(status: Column, values: tuple[str, ...]) -> Column:
    """Null is not in force."""
    return F.coalesce(F.lower(strip(status)).isin(*values), F.lit(False))


def catalog(docs: DataFrame, order: str = "registro") -> DataFrame:
    """Per id the metadata of its first row and all texts joined by line ends, in order."""
    first = F.min_by(F.struct("titulo", "tipo", "subtipo", "url_original", "url_consolidado"), order)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "texto"))), lambda x: x["texto"])
    return docs.groupBy("id").agg(first.alias("m"), F.array_join(texts, "\n").alias("texto"), F.count("*").alias("n_rows")).select("id", "m.*", "texto", "n_rows")


#: Values of a numeric order that lie in one block when a large group is numbered.
NUMBER_BLOCK = 1 << 16


def suffixed(df: DataFrame, base: str, order: str, out: str) -> DataFrame:
    """Unique ids: the second row of a base by ``order`` (a unique number) gets
    ``-2``, the third ``-3``.  Rows are counted in blocks of the order first, so
    that a base of very many rows is numbered in many tasks."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / NUMBER_BLOCK))
    counts = blocked.groupBy(base, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(base).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    held = counts.select(F.col(base).alias("_base"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(base, "_block").orderBy(order))
    n = F.col("_before") + F.col("_own")
    joined = blocked.withColumn("_own", own).join(held, F.col(base).eqNullSafe(F.col("_base")) & F.col("_block").eqNullSafe(F.col("_b")))
    return joined.withColumn(out, F.when(n > 1, F.concat(base, F.lit("-"), n.cast("string"))).otherwise(F.col(base))).select(*df.columns, out)


def numbered(df: DataFrame, out: str, *order: str) -> DataFrame:
    """Rows numbered from 1 through the whole table in an order: sorted by
    ranges, each range numbered on its own behind the counts of those before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # Written in that order, so that counts and rows see the same ranges.
    ranged = materialize(ranged, "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row per range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(held, "_part").select(*df.columns, (F.col("_before") + F.col("_own")).alias(out))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
