"""Diagnostics on planted rows."""

import duckdb

from tessitura.plans import registry

NAME = "chunks_with_all_anchors"


def planted(spark, folder, questions, chunks):
    """What the query finds in these rows, its SQL twin's rows, and the rows that it shuffles."""
    spark.createDataFrame(questions, "question_id string, question string").write.parquet(f"{folder}/gt_questions.parquet")
    spark.createDataFrame(chunks, "chunk_id string, texto string").write.parquet(f"{folder}/metadata.parquet")
    con = duckdb.connect()
    for name in ("gt_questions", "metadata"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    df = registry.queries()[NAME](spark, str(folder)).select("question_id", "chunks")
    got = sorted(map(tuple, df.collect()), key=str)
    return got, sorted(con.sql(registry.oracle_sql()[NAME]).fetchall(), key=str), shuffled(df._jdf.queryExecution().executedPlan())


def shuffled(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten")
    return (own.get().value() if own.isDefined() else 0) + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_anchors_of_repeated_ids(spark, tmp_path):
    questions = [
        ("q1", "tarifa rede"), ("q1", "limite rede"), ("q2", "tarifa"), ("q3", "tarifa tarifa rede"), ("q4", "a de"), ("q5", None), (None, "tarifa"), ("q6", "rede nenhures"),
        ("q7", "tarifa rede"), ("q7", "rede tarifa"), ("q8", "usina turbina"), ("q8", "prazo limite"),
    ]
    chunks = [
        ("c1", "tarifa da rede"), ("c1", "limite da rede"), ("c2", "tarifa tarifa"), ("c3", "Rede, TARIFA"), ("c4", None), (None, "tarifa rede limite"), ("c5", ""),
        ("c6", "usina turbina prazo"), ("c7", "turbina limite usina prazo"),
    ]
    got, twin, _ = planted(spark, tmp_path, questions, chunks)
    assert got == twin == [("q1", 1), ("q2", 3), ("q3", 2), ("q7", 2), ("q8", 1)]


def test_questions_do_not_meet_chunks(spark, tmp_path):
    questions = [(f"q{i}", "tarifa rede") for i in range(200)]
    chunks = [(f"c{i}", "tarifa da rede") for i in range(300)]
    got, twin, rows = planted(spark, tmp_path, questions, chunks)
    assert got == twin and len(got) == 200
    # The words of either side, and a few sums: not one for each of 60,000 pairs.
    assert 0 < rows < 5_000
