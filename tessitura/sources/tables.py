"""Partitioned tables and bundles: scans with checks, and idempotent sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.text import words
from tessitura.operators.ordered import ordered_digest
from tessitura.schemas import STORE_KEYS

SOURCE = "struct<document_id:string,titulo:string,citation_label:string,section_label:string,url:string,support_excerpt:string,relevance:int,grupo:string,tipo:string,subtipo:string>"
GROUND_TRUTH = (
    "question_id string, question string, expected_answer string, query_type string, difficulty string, answerability string, "
    f"tipo string, subtipo string, notes string, relevant_sources array<{SOURCE}>"
)


def bundle_path(root: str, **keys: str) -> str:
    """``root/key=value/...`` in the order given."""
    return "/".join([root.rstrip("/"), *(f"{k}={v}" for k, v in keys.items())])


def read_partitioned(spark: SparkSession, root: str, partitions: tuple[str, ...], keep: Column | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A hive-partitioned table with its partition columns as strings; filters
    on them prune folders and ``columns`` prunes what is read. A folder without
    one of the partitions is an error."""
    df = spark.read.option("basePath", root).parquet(root)
    missing = [p for p in partitions if p not in df.columns]
    if missing:
        raise ValueError(f"{root} is not partitioned by {', '.join(missing)}")
    df = df.withColumns({p: F.col(p).cast("string") for p in partitions})
    if keep is not None:
        df = df.where(keep)
    return df.select(*columns) if columns else df


def write_partitioned(df: DataFrame, root: str, partitions: tuple[str, ...], replace_all: bool = False) -> None:
    """One folder per partition, null partitions kept. Only the partitions of
    ``df`` are replaced, unless all are to be."""
    df.repartition(*partitions).write.option("partitionOverwriteMode", "static" if replace_all else "dynamic").mode("overwrite").partitionBy(*partitions).parquet(root)


def with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order; those ``df`` lacks are null."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines without blank ones; a malformed line is an error, or, if not
    ``strict``, a row with the line in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def publish(df: DataFrame, path: str, force: bool = False) -> None:
    """A version that isn't overwritten unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of the files below a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def store_violations(chunks: DataFrame, parents: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """``*STORE_KEYS, rule, n``: what makes stores unfit to be published.

    ``parents`` (``chunk_id, texto``) are the chunks of the ``hierarchical``
    stores among ``chunks`` if not given; rules on given parents have no store.
    A ``manifest`` is compared with the chunks.
    """
    blank = lambda c: F.size(words(F.coalesce(F.col(c), F.lit("")))) == 0
    expected, size = F.regexp_extract("model", r"(\d+)$", 1).try_cast("int"), F.array_size("embedding")
    child = F.col("chunk_strategy") == "hierarchical-child"
    rules = {
        "null_id": F.col("chunk_id").isNull(), "blank_text": blank("texto"), "no_vector": F.col("embedding").isNull(),
        "dimension": size != expected, "child_without_parent": child & blank("parent_chunk_id"),
    }
    counted = lambda df, **of: df.select(*STORE_KEYS, F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), c.cast("long").alias("n")) for r, c in of.items()))).alias("x")).select(*STORE_KEYS, "x.*").where("n > 0")
    one = chunks.groupBy(*STORE_KEYS).agg(*(F.count_if(c).alias(r) for r, c in rules.items()), (F.countDistinct(size) - 1).alias("mixed_dimension"))
    found = counted(one, **{r: F.col(r) for r in (*rules, "mixed_dimension")})
    ids = chunks.where("chunk_id is not null").groupBy(*STORE_KEYS, "chunk_id").count().groupBy(*STORE_KEYS).agg(F.sum(F.col("count") - 1).alias("n"))
    found = found.unionByName(counted(ids, repeated_id=F.col("n")))
    held = (chunks.where("chunk_strategy = 'hierarchical'") if parents is None else parents).select(F.col("chunk_id").alias("parent"))
    named = chunks.where(child & ~blank("parent_chunk_id")).withColumn("parent", F.trim("parent_chunk_id"))
    unknown = named.join(held.distinct(), "parent", "left_anti").groupBy(*STORE_KEYS).agg(F.count("*").alias("n"))
    found = found.unionByName(counted(unknown, unknown_parent=F.col("n")))
    if parents is not None:
        none = [F.lit(None).cast("string").alias(k) for k in STORE_KEYS]
        sums = parents.agg(F.count_if(blank("texto")).alias("blank"), F.count_if(F.col("chunk_id").isNull()).alias("null")).select(*none, "blank", "null")
        again = parents.where("chunk_id is not null").groupBy("chunk_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(*none, "n")
        found = found.unionByName(counted(sums, blank_parent=F.col("blank"), null_parent_id=F.col("null"))).unionByName(counted(again, repeated_parent=F.col("n")))
    if manifest is not None:
        own = store_manifest(chunks).select(*(F.col(k).alias(f"_{k}") for k in STORE_KEYS), *(F.col(c).alias(f"_{c}") for c in ("chunks", "dimension", "ids_hash")))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in STORE_KEYS]
        both = manifest.withColumn("_m", F.lit(True)).join(own.withColumn("_c", F.lit(True)), same, "full_outer")
        both = both.withColumns({k: F.when(F.col("_m"), F.col(k)).otherwise(F.col(f"_{k}")) for k in STORE_KEYS})
        alone = F.col("_m").isNull() | F.col("_c").isNull()
        differs = lambda c: (~alone & ~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("int")
        found = found.unionByName(counted(both, manifest_store=alone.cast("int"), manifest_count=differs("chunks"), manifest_dimension=differs("dimension"), manifest_hash=differs("ids_hash")))
    return found


def write_store(chunks: DataFrame, root: str, parents: DataFrame | None = None, manifest: DataFrame | None = None, allowed: tuple[str, ...] = ("repeated_id",)) -> None:
    """Chunks with vectors, partitioned by the store's keys; other stores stay.
    An error if any rule of ``store_violations`` that isn't ``allowed`` is broken."""
    broken = store_violations(chunks, parents, manifest).where(~F.col("rule").isin(*allowed)) if allowed else store_violations(chunks, parents, manifest)
    if sums := broken.groupBy("rule").agg(F.sum("n").alias("n")).orderBy("rule").collect():  # one row per rule
        raise ValueError("stores not published: " + ", ".join(f"{r['rule']} {r['n']}" for r in sums))
    write_partitioned(chunks, f"{root}/chunks", STORE_KEYS)
    write_partitioned(store_manifest(chunks), f"{root}/manifest", STORE_KEYS)


def store_manifest(chunks: DataFrame) -> DataFrame:
    """Per store its counts, vector length, documents and the digest of its sorted distinct ids."""
    sums = chunks.groupBy(*STORE_KEYS).agg(
        F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.max(F.array_size("embedding")).alias("dimension"), F.sort_array(F.collect_set("tipo")).alias("tipos")
    )
    digests = ordered_digest(chunks, STORE_KEYS, "chunk_id").select(*(F.col(k).alias(f"_{k}") for k in STORE_KEYS), F.col("digest").alias("ids_hash"))
    joined = sums.join(digests, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in STORE_KEYS], "left")
    return joined.select(*sums.columns, "ids_hash")


def read_store(spark: SparkSession, root: str, with_vectors: bool = True, **keys: str) -> DataFrame:
    """One store; without vectors the vector column isn't read. Error if absent."""
    keep = None
    for k, v in keys.items():
        keep = (F.col(k) == v) if keep is None else keep & (F.col(k) == v)
    df = read_partitioned(spark, f"{root}/chunks", STORE_KEYS, keep)
    if df.isEmpty():
        raise ValueError(f"no store {keys} in {root}")
    return df if with_vectors else df.drop("embedding")


def missing_stores(expected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Expected stores that the manifest doesn't list."""
    return expected.select(*STORE_KEYS).join(manifest, list(STORE_KEYS), "left_anti")


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """``label, signature, line, row``: appended, never rewritten."""
    rows.write.mode("append").json(path)


def load_checkpoint(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Per label the last record whose whole signature is the expected one."""
    from tessitura.operators.ingest import latest_per_key

    log = spark.read.schema("label string, signature string, line bigint, row string").json(path)
    return latest_per_key(log.join(expected.select("label", "signature"), ["label", "signature"]), ("label",), F.desc("line"))


def missing_contexts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Questions that a replay has no contexts for."""
    return questions.select("question_id").join(contexts.select("question_id"), "question_id", "left_anti")
