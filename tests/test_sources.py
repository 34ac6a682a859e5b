from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.sources import extraction
from tessitura.sources import tables as S
from tessitura.streaming import incremental


def test_partitioned_round_trip(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "1", "texto"), (2, "1", "markdown"), (3, None, "texto")], "i int, tipo string, metodo_extracao string")
    S.write_partitioned(df, root, ("tipo", "metodo_extracao"))
    back = S.read_partitioned(spark, root, ("tipo", "metodo_extracao"))
    assert dict(back.dtypes)["tipo"] == "string" and sorted(r.i for r in back.collect()) == [1, 2, 3]
    S.write_partitioned(df.where("i = 2").withColumn("i", F.lit(9)), root, ("tipo", "metodo_extracao"))
    assert sorted(r.i for r in S.read_partitioned(spark, root, ("tipo", "metodo_extracao")).collect()) == [1, 3, 9]
    assert [r.i for r in S.read_partitioned(spark, root, ("tipo",), F.col("metodo_extracao") == "markdown", ("i",)).collect()] == [9]
    with pytest.raises(ValueError):
        S.read_partitioned(spark, root, ("ano",))
    assert S.bundle_path("r/", a="1", b="2") == "r/a=1/b=2"


def test_json_lines(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"question_id": "gt-0001", "relevant_sources": [{"document_id": "d", "relevance": 2}]}\n\n{"question_id": "gt-0002"}\n')
    rows = S.read_json_lines(spark, str(path), S.GROUND_TRUTH).orderBy("question_id").collect()
    assert rows[0].relevant_sources[0].relevance == 2 and rows[1].relevant_sources is None
    path.write_text('{"question_id": "gt-0001"}\nnot json\n')
    with pytest.raises(Exception):
        S.read_json_lines(spark, str(path), S.GROUND_TRUTH).collect()
    lenient = S.read_json_lines(spark, str(path), S.GROUND_TRUTH, strict=False).collect()
    assert [r._corrupt_record for r in lenient if r.question_id is None] == ["not json"]
    out = str(tmp_path / "v1")
    S.publish(spark.range(2), out)
    with pytest.raises(Exception):
        S.publish(spark.range(2), out)
    S.publish(spark.range(3), out, force=True)
    assert S.file_digests(spark, out).where("length(sha256) = 64").count() >= 1


def test_store_and_checkpoint(spark, data, tmp_path):
    root = str(tmp_path / "store")
    chunks = spark.read.parquet(f"{data}/metadata.parquet").where("chunk_strategy <> 'hierarchical-child'")
    S.write_store(chunks, root)
    key = chunks.select(*S.STORE_KEYS).first().asDict()
    one = S.read_store(spark, root, with_vectors=False, **key)
    assert "embedding" not in one.columns and one.count() > 0
    with pytest.raises(ValueError):
        S.read_store(spark, root, provider="none")
    manifest = S.read_partitioned(spark, f"{root}/manifest", S.STORE_KEYS)
    assert S.missing_stores(chunks.distinct(), manifest).count() == 0
    log = str(tmp_path / "log")
    kinds = "label string, signature string, line bigint, row string"
    S.append_checkpoint(spark.createDataFrame([("a", "s", 1, "old"), ("a", "other", 3, "no"), ("a", "s", 2, "new")], kinds), log)
    expected = spark.createDataFrame([("a", "s"), ("b", "s")], "label string, signature string")
    assert [(r.label, r.row) for r in S.load_checkpoint(spark, log, expected).collect()] == [("a", "new")]
    wide = S.with_columns(spark.range(1), T.StructType([T.StructField("x", T.StringType()), T.StructField("id", T.LongType())]))
    assert wide.columns == ["x", "id"] and wide.first().x is None


def test_store_gate(spark, tmp_path):
    kinds = "provider string, model string, chunk_strategy string, metodo_extracao string, chunk_id string, document_id string, parent_chunk_id string, texto string, embedding array<float>, tipo string"
    row = lambda i, parent=None, text="texto", vector=(1.0, 2.0), kind="hierarchical": ("p", "m-2", kind, "texto", i, "d", parent, text, vector and list(vector), "t")
    frame = lambda *rows: spark.createDataFrame(rows, kinds)
    rules = lambda *a: {r.rule: r.n for r in S.store_violations(*a).groupBy("rule").agg(F.sum("n").alias("n")).collect()}
    good = frame(row("a"), row("b"), row("c", "a", kind="hierarchical-child"))
    assert rules(good, None, S.store_manifest(good)) == {}
    bad = frame(row("a"), row("a"), row(None), row("e", text=" "), row("f", vector=None), row("g", vector=(1.0,)), row("c", "x", kind="hierarchical-child"), row("d", " ", kind="hierarchical-child"))
    assert rules(bad) == {"repeated_id": 1, "null_id": 1, "blank_text": 1, "no_vector": 1, "dimension": 1, "mixed_dimension": 1, "unknown_parent": 1, "child_without_parent": 1}
    parents = spark.createDataFrame([("a", "x"), ("a", ""), (None, "x")], "chunk_id string, texto string")
    assert rules(good, parents) == {"blank_parent": 1, "null_parent_id": 1, "repeated_parent": 1}
    other = frame(row("a"), row("z"), row("y", kind="fixed-size"), row("c", "a", kind="hierarchical-child"), row("d", "a", kind="hierarchical-child"))
    assert rules(good, None, S.store_manifest(other)) == {"manifest_store": 1, "manifest_count": 1, "manifest_hash": 2}
    with pytest.raises(ValueError, match="blank_text 1.*null_id 1"):
        S.write_store(bad, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="repeated_id 1"):
        S.write_store(frame(row("a"), row("a")), str(tmp_path / "s"), allowed=())


def test_extraction(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"corpo")
    (tmp_path / "c.html").write_bytes("<p>Um parágrafo é isto.</p>".encode("latin-1"))
    (tmp_path / "d.docx").write_bytes(b"damaged")
    (tmp_path / "e.xyz").write_bytes(b"x")

    def parse(content):
        return {b"corpo": "Corpo"}[content]  # a parser's own KeyError is no unknown format

    files = spark.read.format("binaryFile").load(str(tmp_path))
    text = {r.path[-6:]: (r.texto, r.erro) for r in extraction.extract(files, "texto", {("docx", "texto"): parse}).collect()}
    assert text["a.docx"] == ("Corpo", None) and text["c.html"] == ("Um parágrafo é isto.", None)
    assert text["d.docx"] == (None, "KeyError") and text["/e.xyz"] == (None, "unknown format")
    assert {r.erro for r in extraction.extract(files, "markdown").where("formato = 'docx'").collect()} == {"unknown format"}
    with pytest.raises(ValueError):
        extraction.extract(files, "pdf")


def test_streaming(spark, data, tmp_path):
    corpus = spark.read.parquet(f"{data}/corpus.parquet")
    source = str(tmp_path / "in")
    corpus.write.parquet(source)
    stream = spark.readStream.schema(corpus.schema).parquet(source)
    incremental.merge_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    merged = spark.read.parquet(f"{tmp_path}/out/version=00000000")
    assert merged.count() == corpus.select("id", "metodo_extracao").distinct().count()
    events = spark.read.parquet(f"{data}/events.parquet")
    ein = str(tmp_path / "ein")
    events.write.parquet(ein)
    counts = incremental.window_counts(spark.readStream.schema(events.schema).parquet(ein))
    counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == events.where("ts is not null").count()


def test_clean(spark):
    from tessitura.session import clean, materialize

    df = materialize(spark.range(3), "some")
    path = df.inputFiles()[0].removeprefix("file://")
    other = spark.newSession()
    assert Path(path).exists() and spark.sparkContext.applicationId in path
    clean(other)
    assert not Path(path).exists()
