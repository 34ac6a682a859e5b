import numpy as np
import pytest

from tessitura.operators import evaluation as E
from tessitura.operators import ingest, runs
from tessitura.operators import matching as M
from tessitura.operators import retrieval as R


def test_upsert(spark):
    kinds = "registro long, id string, metodo_extracao string, scraped_at string"
    old = spark.createDataFrame([(1, "a", "texto", "2024-01-01"), (2, "a", "markdown", "x"), (3, "b", "texto", "2024-01-05T00:00:00Z")], kinds)
    new = spark.createDataFrame([(4, "a", "texto", "2024-02-01T00:00:00Z"), (5, "a", "markdown", None), (6, "b", "texto", "2024-01-01")], kinds)
    assert sorted(r.registro for r in ingest.upsert(old, new).collect()) == [3, 4, 5]


def test_missing_methods_and_suffixes(spark):
    df = spark.createDataFrame([("a", "texto"), ("b", "texto"), ("b", "markdown"), (None, "texto")], "id string, metodo_extracao string")
    assert [tuple(r) for r in ingest.missing_methods(df).collect()] == [("a", "markdown")]
    s = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i int, base string")
    assert {r.i: r.u for r in ingest.suffixed(s, "base", "i", "u").collect()} == {1: "x", 2: "x-2", 3: "y"}


def test_runs_round_trip(spark):
    rng = np.random.default_rng(2)
    rows = [(i // 25, i, *[str(v) if (v := int(rng.integers(0, 4))) else None for _ in range(3)]) for i in range(100)]
    df = spark.createDataFrame(rows, "page long, pos long, a string, b string, c string")
    encoded = runs.encode_repeats(df, "page", "pos", ["a", "b", "c"])
    assert encoded.where("mask > 0").count() > 20
    assert sorted(map(tuple, runs.decode_repeats(encoded, "page", "pos", ["a", "b", "c"]).collect())) == rows


def test_exact_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vector array<double>").repartition(5)
    got = {}
    for r in R.exact_top_k(df.where("item % 100 = 0 or item = 3").withColumnRenamed("item", "query"), df, 4).collect():
        got.setdefault(r.query, {})[r.rank] = r.item
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 3, 100, 200):
        s = np.round(u @ u[q], 9)
        s[q] = -9
        assert [got[q][k] for k in range(1, 5)] == np.argsort(-s, kind="stable")[:4].tolist()
    assert R.pool_size(10) == 10 and R.pool_size(10, widened=True) == 50 and R.pool_size(20, widened=True) == 100 and R.pool_size(10, 3) == 10
    with pytest.raises(ValueError):
        R.pool_size(0)


def test_superseded(spark):
    ids = ["p-subm2-1-v-1-0", "p-subm2-1-v-2-0", "p-subm2-1-v-2-0-aren5", "p-subm3-1-v-1-0", "lei-1", None]
    df = spark.createDataFrame([(i,) for i in ids], "document_id string")
    assert sorted(r.document_id for r in R.superseded(df).collect()) == ["p-subm2-1-v-1-0", "p-subm2-1-v-2-0"]


def test_parents_and_injection(spark):
    hits = spark.createDataFrame([(1, "c1", "p1", 0.5, 2), (1, "c2", "p1", 0.9, 1), (1, "c3", "p2", 0.7, 3), (1, "c4", None, 0.6, 4), (1, "c5", "gone", 0.8, 5)], "query int, chunk_id string, parent_chunk_id string, score double, rank int")
    parents = spark.createDataFrame([("p1",), ("p2",), ("p2",)], "chunk_id string")
    assert [tuple(r) for r in R.expand_to_parents(hits, parents).orderBy("rank").collect()] == [(1, "p1", 0.9, 1), (1, "p2", 0.7, 2)]
    c = spark.createDataFrame([(1, "a", 0.5)], "query int, chunk_id string, score double")
    m = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "query int, chunk_id string")
    assert sorted(map(tuple, R.inject(c, m).collect())) == [(1, "a", 0.5), (1, "b", 0.0)]


def test_matching(spark):
    q = spark.createDataFrame([("q1", [("d1", "Art. 1º", "prazo de contratação anual", 3, "g"), ("d2", None, "tarifa social residencial", 2, "g"), ("d3", "Art. 9", None, 1, None)])],
        "question_id string, relevant_sources array<struct<document_id:string,section_label:string,support_excerpt:string,relevance:int,grupo:string>>")
    sources = M.expected_sources(q)
    retrieved = spark.createDataFrame([(1, "q1", 1, "d1", "art2", ["x"]), (1, "q1", 2, "d2", "", ["tarifa", "social", "residencial"]), (1, "q1", 3, "d1", "art1.par2", [])],
        "query int, question_id string, rank int, document_id string, signature string, tokens array<string>")
    judged = M.judged(retrieved, sources)
    assert M.grades(retrieved, judged).first().grades == [0, 2, 3]
    queries = spark.createDataFrame([(1, "q1"), (2, "none")], "query int, question_id string")
    cover = {r.query: r.recall for r in M.group_coverage(queries, sources, judged.where("hit"), "recall").collect()}
    assert cover == {1: 0.5, 2: 0.0}


def test_pairing(spark):
    kinds = "config string, question_id string, answer_usable boolean, failure_type string, doc_recall_at_k double, recall_at_k double"
    rows = [(c, f"q{i}", u, f, 1.0, 1.0) for i, (a, b) in enumerate([((True, "usable"), (True, "usable")), ((False, "x"), (True, "usable")), ((True, "usable"), (False, "x")), ((False, "x"), (False, "x")), ((False, "x"), (False, None))]) for c, (u, f) in (("a", a), ("b", b))]
    rows.append(("a", "only", True, "usable", 1.0, 1.0))
    results = spark.createDataFrame(rows, kinds)
    pairs = spark.createDataFrame([("a > b", "a", "b")], "pair string, before string, after string")
    paired = E.pair_results(results, pairs)
    assert [r.bucket for r in paired.orderBy("question_id").collect()] == ["stable_pass", "saved", "broken", "stable_fail_same_type", "stable_fail_changed_type"]
    v = E.verdicts(paired).first()
    assert (v.saved, v.broken, v.verdict, v.reasons) == (1, 1, "keep", "saved_below_twice_broken")
    assert [tuple(r) for r in E.question_asymmetry(results, pairs).collect()] == [("a > b", "only", "before")]


def test_small_scores(spark):
    df = spark.createDataFrame([(["a::1", None], ["a::1"], ["Vigente", "x"], "vigente"), ([None], ["a::1"], [], "vigente"), ([], [], ["x"], None)], "f array<string>, e array<string>, s array<string>, w string")
    got = df.select(E.article_hit(df.f, df.e).alias("hit"), E.status_accuracy(df.s, df.w).alias("status")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.5), (0.0, 0.0), (0.0, 0.0)]
    t = spark.createDataFrame([(True, False, 1.0, 0.5), (True, False, 1.0, 1.0), (True, False, None, 1.0), (False, False, 1.0, 0.0)], "b boolean, a boolean, x double, y double")
    assert [r.h for r in t.select(E.hard_break(t.b, t.a, t.x, t.y).alias("h")).collect()] == [True, False, True, False]
    ids = spark.range(100)
    assert E.seeded_sample(ids, "id", 5).collect() == E.seeded_sample(ids.repartition(7), "id", 5).collect() != E.seeded_sample(ids, "id", 5, 1).collect()
    both = spark.createDataFrame([(1, None)], "a int, b string")
    assert both.select(E.fingerprint("a", "b")).first()[0] == both.select(E.fingerprint("b", "a")).first()[0]
    m = E.run_manifest("r1", spark.createDataFrame([("c", 0.5)], "config string, recall double"), spark.createDataFrame([("c", True)], "label string, rerank boolean"))
    assert m.first().manifest == '{"config":"c","recall":0.5,"rerank":true}'


def test_ground_truth_gate(spark):
    from tessitura.plans.evaluation import ground_truth_errors

    def errors(ids, answer="prazo contratual energia tarifa", excerpt="prazo contratual energia tarifa", kind="corpus_supported", doc="d1"):
        rows = [(i, answer, kind, [(doc, excerpt)]) for i in ids]
        q = spark.createDataFrame(rows, "question_id string, expected_answer string, answerability string, relevant_sources array<struct<document_id:string,support_excerpt:string>>")
        return {r.rule: r.n for r in ground_truth_errors(q, corpus).collect()}

    corpus = spark.createDataFrame([("d1", "O prazo contratual"), ("d1", "energia e tarifa"), ("d2", None)], "id string, texto string")
    good = [f"gt-{i:04}" for i in range(1, 5)]
    assert errors(good) == {}
    assert errors([good[0], good[3], good[3], "gt-0000", "gt-00002", None]) == {"id_form": 3, "id_repeated": 1, "id_gap": 2}
    assert errors(good[:2], excerpt="prazo contratual") == {"answer_coverage": 2}  # 0.5
    assert errors(good[:1], excerpt="prazo contratual energia sistema") == {}  # 0.75 both ways
    assert errors(good[:1], excerpt="prazo contratual energia distante montante") == {"excerpt_coverage": 1}  # 0.6
    assert errors(good[:1], excerpt="prazo contratual energia distante montante", kind="source_only") == {}
    assert errors(good[:2], doc="d2") == {"excerpt_coverage": 2} and errors(good[:2], doc="none") == {"source_not_in_corpus": 2}
