from pyspark.sql import functions as F

from tessitura.functions import html as H
from tessitura.functions import providers as P
from tessitura.functions import text as T
from tessitura.functions.keys import loose_id
from tessitura.functions.times import instant_micros, parse_instant
from tessitura.operators import evaluation as E


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) and v and isinstance(v[0], str) else 'array<int>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def test_words_and_normalisation(spark):
    assert one(spark, T.words(F.col("t")), t=" a\xa0b\x1cc\x85 d\r\n") == ["a", "b", "c", "d"]
    assert one(spark, T.normalized(F.col("t")), t="Produçăo, 1º NÃO") == one(spark, T.normalized(F.col("t")), t="produção 1º não") == "producao 1o nao"
    assert one(spark, T.informative(F.col("t")), t="O DEC da energia e a FEC kv x rede rede") == ["dec", "energia", "fec", "kv", "rede", "rede"]
    assert one(spark, loose_id(F.col("t")), t=" \tREN-1\xa0") == "ren-1"


def test_times(spark):
    micros = lambda t: one(spark, instant_micros(F.col("t")), t=t)
    assert micros("1970-01-01T00:00:01Z") == micros("1970-01-01 00:00:01") == micros("1969-12-31T21:00:01-03:00") == 1_000_000
    assert micros("1970-01-02") == 86_400_000_000
    assert micros("sem data") == micros("") == micros(None) == -(2**62)
    assert one(spark, parse_instant(F.col("t")).isNull(), t="2023-13-40T00:00:00Z")


def test_signatures(spark):
    sig = T.chunk_signature(F.lit("Art. 1º"), F.lit("§ 1º"), F.lit("II"), F.lit("a"))
    assert one(spark, sig, t="") == "art1.par1.incii.alia" == one(spark, T.label_signature(F.col("t")), t="Art. 1º, § 1º, inciso II, alínea a")
    match = lambda a, b: one(spark, T.signatures_match(F.col("a"), F.col("b")), a=a, b=b)
    assert match("art1", "art1.par2") and match("art1.par2", "art1") and not match("art1", "art10") and not match("", "")
    assert [one(spark, T.grade(F.col("r")), r=r) for r in (0, 1, 3, 9, -4)] == [1, 1, 3, 3, 1]


def test_versions_and_modules(spark):
    v = lambda d: one(spark, T.version(F.col("d")), d=d)
    order = ["x-subm2-1-v-1-9c-z", "x-subm2-1-v-1-10c", "x-subm2-1-v-2-0", "x-subm2-1-v-2-0c-aren1", "x-subm2-1-v-2-1"]
    assert [tuple(v(d)) for d in order] == sorted(tuple(v(d)) for d in order) and v("lei-1") is None
    m = lambda d, k: one(spark, T.matches_module(F.col("d"), F.col("k")), d=d, k=k)
    assert m("proret-subm2-1-v-2-5", "2-1") and not m("proret-subm2-1a-v-1", "2-1") and not m("proret-subm2-10", "2-1") and not m("x-v-2-5", "2-5") and not m("x", "")
    assert one(spark, T.query_module(F.col("q")), q="O que diz o Submódulo 2.1A?") == "2-1a" and one(spark, T.query_module(F.col("q")), q="nada") is None


def test_labels(spark):
    label = T.citation_label(F.lit("Norma"), F.lit("d"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(4))
    assert one(spark, label, t="") == "Norma, chunk 4"
    assert one(spark, T.chunk_id(F.lit("d"), F.lit("texto"), F.lit("fixed-size"), F.lit(12345)), t="") == "d::texto::fixed-size::12345"
    assert one(spark, T.slug(F.col("t")), t="  Ação & Reação!  ") == "acao-reacao" and one(spark, T.slug(F.col("t")), t="!!") == "documento"
    assert one(spark, T.noise_class(F.col("t")), t="Página 12") == "numero_pagina" and one(spark, T.noise_class(F.col("t")), t="uma frase comum") == "outro"


def test_metrics(spark):
    assert one(spark, E.ndcg(F.col("g")), g=[3, 0, 2, 0, 1]) == 0.9212478445981336
    assert one(spark, E.ndcg(F.col("g")), g=[0, 3]) == 0.6309297535714574
    assert one(spark, E.ndcg(F.col("g")), g=[0, -1]) == 0.0 and one(spark, E.reciprocal_rank(F.col("g")), g=[0, 0, 2]) == 1 / 3
    f = lambda **k: one(spark, E.failure_type(E.usable(F.col("r"), F.col("c"), F.col("k")), F.col("g"), F.col("r"), F.col("d"), F.col("c"), F.col("k")), **k)
    assert f(r=1.0, d=1.0, c=0.9, k=0.9, g="ok") == "usable" and f(r=0.0, d=0.0, c=0.9, k=0.9, g="error") == "generator_failure"
    assert f(r=0.0, d=0.0, c=0.9, k=0.9, g="ok") == "retrieval_document_failure" and f(r=0.0, d=1.0, c=0.9, k=0.9, g="ok") == "retrieval_passage_failure"
    assert f(r=1.0, d=1.0, c=0.1, k=0.1, g="ok") == "citation_and_answer_failure" and f(r=1.0, d=1.0, c=0.9, k=0.1, g="ok") == "answer_quality_failure"
    assert one(spark, E.citation_precision(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x"]) == 0.5


def test_html(spark):
    page = "<html><script>var x = 1;</script><nav><p>menu de navegação</p></nav><p>Um <b>texto</b> &amp; mais texto.</p><p>curto</p><h2>Título</h2><ul><li>um</li></ul><a href='x'>n</a><a href=\"/a.PDF?v=1\">Arquivo <i>um</i></a><a href=\"#t\">topo</a></html>"
    assert one(spark, H.html_text(F.col("h")), h=page) == "Um texto & mais texto."
    md = one(spark, H.html_markdown(F.col("h")), h=page)
    assert "**texto** & mais" in md and "## Título" in md and "* um" in md and "var x" not in md
    assert [tuple(x) for x in one(spark, H.links(F.col("h")), h=page)] == [("x", "n"), ("/a.PDF?v=1", "Arquivo um")]
    seen = one(spark, H.links(F.col("h"), F.lit("https://s.example/atos/2020/i.html?x#y")), h="<A HREF='/a'>1</A><a href=b.pdf>2</a><a href=\"./c&amp;d\">3</a><a href='//o.example/e'>4</a><a href='mailto:x@y'>5</a><a href=''>6</a>")
    assert [x.href for x in seen] == ["https://s.example/a", "https://s.example/atos/2020/b.pdf", "https://s.example/atos/2020/c&d", "https://o.example/e", "mailto:x@y"]
    assert one(spark, H.absolute(F.lit("a"), F.col("h")), h="https://s.example") == "https://s.example/a"


def test_entities(spark):
    text = "regula&ccedil;&atilde;o &#233; &#xE9;&#x1F50C; &amp;lt; &nada; &nbsp;&euro; &#0; &#55296; R&D; fim&"
    assert one(spark, H.unescape(F.col("h")), h=text) == "regulação é é🔌 &lt; &nada; \xa0€ &#0; &#55296; R&D; fim&"
    assert one(spark, H.unescape(F.col("h")), h="sem nada") == "sem nada" and one(spark, H.unescape(F.lit(None).cast("string")), h="") is None


def test_combining_accents(spark):
    import unicodedata

    text = "Regulação da DISTRIBUIÇÃO nº 3"
    for form in ("NFC", "NFD"):
        t = unicodedata.normalize(form, text)
        assert one(spark, T.normalized(F.col("h")), h=t) == "regulacao da distribuicao no 3"
        assert one(spark, T.slug(F.col("h")), h=t) == "regulacao-da-distribuicao-n-3"


def test_answers_and_ids(spark):
    assert one(spark, T.cited_indices(F.col("h"), F.lit(3)), h="a [2] b [1][2] c [7] [0] [x]") == [2, 1]
    assert one(spark, T.path_id(F.col("h")), h="https://s.example/atos/REN nº 1000.2021.pdf?v=1") == "ren-n-1000-2021"
    assert one(spark, T.plain_text(F.lit(None).cast("string"), F.col("h")), h=" a\xa0\n") == "a"
    assert one(spark, T.finite(F.col("h").cast("double")), h="NaN") is None and one(spark, T.finite(F.col("h").cast("double")), h="2") == 2.0
    assert one(spark, H.file_format(F.col("u")), u="/a.PDF?v=1") == "pdf" and one(spark, H.file_format(F.col("u")), u="/a") is None


def test_providers(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "done"

    assert P.with_retry(flaky, sleep=lambda s: None)() == "done" and len(calls) == 3
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "k int, t string")
    got = {r.k: r.embedding for r in P.embed(df, "k", "t", lambda ts: [[float(len(t)), 1.0] for t in ts], 2, batch=1).collect()}
    assert got == {1: [3.0, 1.0], 2: [3.0, 1.0], 4: [1.0, 1.0]}
    pool = spark.createDataFrame([(1, "a b", f"c{i}", t, i) for i, t in enumerate(["x", "a", "a b", "b"])], "query_id int, query string, chunk_id string, text string, pos int")
    assert [(r.chunk_id, r.rank) for r in P.rerank(pool, 3).orderBy("rank").collect()] == [("c2", 1), ("c1", 2), ("c3", 3)]
    q = spark.createDataFrame([(1, "q", ["um  texto"]), (2, "q", [])], "k int, q string, c array<string>")
    assert {r.k: (r.answer, r.status) for r in P.generate(q, "k", "q", "c").collect()} == {1: ("um texto", "skipped_no_generator"), 2: (P.NO_CONTEXT, "empty_contexts")}
    failing = {r.k: (r.status, r.error) for r in P.generate(q, "k", "q", "c", lambda query, ctx: 1 / 0).collect()}
    assert failing == {1: ("error", "ZeroDivisionError"), 2: ("empty_contexts", None)}
    assert one(spark, P.guarded_expansion(F.col("o"), F.col("e")), o="prazo na REN 1/2020", e="prazos") == "prazo na REN 1/2020"
