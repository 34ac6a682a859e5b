"""The retrieval pipeline and the operators that number or deduplicate rows, on small made-up rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import ingest
from tessitura.operators import pipeline as P
from tessitura.operators import retrieval as R

CHUNKS = "chunk_id string, document_id string, chunk_strategy string, metodo_extracao string, parent_chunk_id string, situacao string, texto string"
CONFIGS = "label string, chunk_strategy string, metodo_extracao string, mode string, candidates_k_override int, rerank boolean, exclude_revogadas boolean, exclude_superseded_versions boolean, restrict_to_query_submodulo boolean, boost_identificador boolean"


def chunks(spark):
    rows = [
        ("a", "p-subm2-1-v-1-0", "s", "m", None, " Revogada", "prazo de revisão do contrato"), ("b", "p-subm2-1-v-2-0", "s", "m", None, None, "prazo de revisão"), ("c", "ren-1", "s", "m", None, "vigente", "prazo de revisão do contrato anual"),
        ("d", None, "s", "m", None, None, "outra coisa"), ("e", "ren-2", "s", "x", None, None, "prazo de revisão do contrato"),
        ("k1", "ren-3", "child", "m", "P1", None, "prazo de revisão"), ("k2", "ren-3", "child", "m", "P1", None, "prazo"), ("k3", "ren-4", "child", "m", "gone", None, "prazo de revisão do contrato"), ("P1", "ren-3", "hierarchical", "m", None, None, "pai"),
    ]
    return spark.createDataFrame(rows, CHUNKS).withColumn("vector", R.hash_vector(F.col("texto")))


def queries(spark):
    q = spark.createDataFrame([(1, "prazo de revisão do contrato"), (2, "O que diz o Submódulo 2.1 sobre contrato?")], "query long, question string")
    return q.withColumn("vector", R.hash_vector(F.col("question")))


def run(spark, *rows, k=3):
    configs = spark.createDataFrame(rows, CONFIGS)
    return {(r.label, r.query, r["rank"]): r.chunk_id for r in P.run_configs(queries(spark), chunks(spark), configs, k).collect()}


def test_switches(spark):
    got = run(
        spark, ("all", "s", "m", "flat", None, None, None, None, None, None), ("force", "s", "m", "flat", None, False, True, True, False, False), ("named", "s", "m", "flat", None, False, False, False, True, False),
        ("few", "s", "m", "flat", 1, False, False, False, False, True), ("deep", "child", "m", "hierarchical", None, False, False, False, False, False), ("words", "s", "m", "flat", None, True, False, False, False, False))
    assert got["all", 1, 1] == "a" and got["words", 1, 1] == "a" and got["words", 1, 2] == "c"  # equal shares keep the pool's order
    assert got["force", 1, 1] == "c" and "a" not in {v for (label, *_), v in got.items() if label == "force"}
    assert {v for (label, q, _), v in got.items() if label == "named" and q == 2} == {"a", "b"}
    assert {v for (label, q, _), v in got.items() if label == "few" and q == 2} >= {"a", "b"}  # added to a pool of three
    assert {v for (label, q, _), v in got.items() if label == "deep"} == {"P1"}


def test_document_metrics(spark):
    runs = spark.createDataFrame([("x", 1, "d1", 1), ("x", 1, "d2", 2), ("x", 2, "d9", 1)], "label string, query long, document_id string, rank int")
    q = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "query long, question_id string")
    s = spark.createDataFrame([("q1", "d2", "g"), ("q1", "d7", "h"), ("q2", "d8", "g")], "question_id string, document_id string, grp string")
    got = {r.query: (r.doc_recall, r.mrr, r.first_rank) for r in P.document_metrics(runs, q, s).collect()}
    assert got == {1: (0.5, 0.5, 2), 2: (0.0, 0.0, None), 3: (0.0, 0.0, None)}


def test_parts_and_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "ITEM_BLOCK", 7)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, "ab"[i % 2], [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(60)] + [(60, None, [1.0, 0.0, 0.0, 0.0]), (61, "a", None)]
    items = spark.createDataFrame(rows, "item long, part string, vector array<double>")
    got = {}
    for r in R.exact_top_k(items.where("item % 7 = 0").withColumnRenamed("item", "query"), items, 4).collect():
        got.setdefault(r.query, []).append((r["rank"], r.item))
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    for i, part, v in rows[:60]:
        if i % 7 == 0:
            scored = sorted((-round(sum(x * y for x, y in zip(unit(v), unit(w))), 9), j) for j, p, w in rows[:60] if p == part and j != i)
            assert [x for _, x in sorted(got[i])] == [j for _, j in scored[:4]]
    with pytest.raises(Exception, match="different lengths"):
        R.exact_top_k(items.where("item = 1").drop("part").withColumnRenamed("item", "query"), spark.createDataFrame([(1, [1.0]), (2, [2.0])], "item long, vector array<double>"), 1).collect()


def test_numbers_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ingest, "NUMBER_BLOCK", 10)
    rows = [(i, "x" if i % 3 else "y") for i in range(100)] + [(200, None), (201, None)]
    got = {r.i: r.out for r in ingest.suffixed(spark.createDataFrame(rows, "i long, base string"), "base", "i", "out").collect()}
    seen = {}
    for i, base in rows[:100]:
        seen[base] = seen.get(base, 0) + 1
        assert got[i] == (base if seen[base] == 1 else f"{base}-{seen[base]}")
    assert len(got) == 102
    numbered = ingest.numbered(spark.createDataFrame(rows, "i long, base string").repartition(5), "n", "base", "i").collect()
    assert [r.n for r in sorted(numbered, key=lambda r: (r.base is not None, r.base or "", r.i))] == list(range(1, 103))


def test_latest_of_few(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")]
    got = ingest.latest_of_few(spark.createDataFrame(rows, "k string, t int, v string"), "k", F.desc("t")).collect()
    assert sorted((str(r.k), r.v) for r in got) == [("None", "n"), ("a", "y"), ("b", "z")]
