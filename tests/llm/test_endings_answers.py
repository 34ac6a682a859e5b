import random

import pytest

from tessitura.llm import answers as A
from tessitura.llm import endings as E

NOUNS = "contrato relatório barramento desconto cronograma operador gerador conselho perfil leilão subsídio".split()
ADJECTIVES = "anual público elétrico tarifário residencial contábil remoto setorial".split()


def sentence(rng):
    noun = lambda: f"{rng.choice(NOUNS)} {rng.choice(ADJECTIVES)}"
    return rng.choice(["Compete ao {} verificar o {}, a contar do {}.", "O prazo para revisar o {} é de %d dias, observado o {} do {}." % rng.randint(2, 99), "Fica vedado medir o {} pelo {} sem prejuízo do {}."]).format(noun(), noun(), noun())


def made(n, seed=0):
    rng, rows, cut = random.Random(seed), [], set()
    for i in range(n):
        text = "\n".join(" ".join(sentence(rng) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 6)))
        if rng.random() < 0.2:
            text += "\n" + rng.choice(["Anexo XIV", "Página 36", "– revisar o contrato", "https://acervo.example/docs/77"])
        if rng.random() < 0.15:
            at = rng.randint(40, len(text) - 2)
            if text[at - 1].isalpha() and text[at].isalpha():
                text = text[:at] + rng.choice(["", "", "…", " [", "\n"])
                cut.add(i)
        rows.append((i, text, rng.choice(["pt", "PT", "pt-BR", None])))
    return rows, cut


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, texto string, lang string, text string, item int")


def test_held_out_accuracy(spark):
    rows, cut = made(2500)
    found = {r.doc_id for r in E.find_cut_texts(frame(spark, rows), "doc_id", "texto", "lang").collect()}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.03 * len(cut)


def test_lengths_have_no_bound(spark):
    rng = random.Random(7)
    limit = 1 << 20
    rows = [(i, (f"Texto {i}. " + sentence(rng) + " " + "a" * limit)[:limit], "pt") for i in range(12)]
    rows += [(100 + i, sentence(rng), "pt") for i in range(50)]
    _, features = E.fit_endings(frame(spark, rows), "doc_id", "texto", "lang")
    assert [r.chars for r in E._limits(features, "chars").collect()] == [limit]


def test_limits_look_at_neighbours_of_their_group(spark):
    counts = {100: 40, 101: 3, 99: 2, 500: 7, 700: 9, **{x: 30 for x in range(900, 1000)}, 950: 80, 3: 8}
    rows = [("a", x) for x, n in counts.items() for _ in range(n)] + [("b", 500)] * 20 + [(None, 1)]
    found = {(r.grp, r.chars): r.chars_excess for r in E._limits(spark.createDataFrame(rows, "grp string, chars long"), "chars").collect()}
    want = {("b", 500): (20 - 0.5) / 20}
    for length, n in counts.items():
        near = sorted(counts.get(x, 0) for x in range(length - 20, length + 21) if x != length)
        usual = sum(near[:-4]) / 36 + 0.5
        if n > max(7, usual + 4 * usual**0.5 + 4):
            want["a", length] = (n - usual) / n
    assert found.keys() == want.keys() >= {("a", 100), ("a", 700), ("a", 950), ("a", 3)} and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_a_source_with_a_field_limit(spark):
    """Cuts after whole words are told by the limit of their source; other texts of that length are whole."""
    rng, rows, cut = random.Random(3), [], set()
    for i in range(1500):
        text = " ".join(sentence(rng) for _ in range(rng.randint(2, 9)))
        source = "cutting" if i % 3 == 0 else "whole"
        if source == "cutting" and len(text) > 300 and text[299] != ".":
            text = text[:300]
            cut.add(i)
        rows.append((i, text, "pt", source))
    df = spark.createDataFrame(rows, "doc_id long, texto string, lang string, source string")
    found = {r.doc_id for r in E.find_cut_texts(df, "doc_id", "texto", "lang", "source").collect()}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.03 * len(cut)
    shares = {r.source: r.share for r in E.cut_shares(df, "doc_id", "texto", "lang", "source").collect()}
    assert shares["whole"] < 0.02 < 0.5 * len(cut) / 500 < shares["cutting"]


def test_edge_cases(spark):
    rows, _ = made(200)
    rows += [(900, None, "pt"), (901, "", "pt"), (902, " \n\t", None), (903, "…", "pt"), (904, "palavra " * 200_000, "pt"), (905, rows[0][1], "pt"), (905, rows[0][1], "pt")]
    found = {r.doc_id for r in E.find_cut_texts(frame(spark, rows), "doc_id", "texto", "lang").collect()}
    assert not found & {900, 901, 902, 903}
    assert E.find_cut_texts(frame(spark, rows).limit(0), "doc_id", "texto", "lang").count() == 0
    shares = E.cut_shares(frame(spark, rows), "doc_id", "texto", "lang", "text").collect()
    assert len(shares) == 1 and 0 <= shares[0].share <= 1


def test_peel():
    assert E.peel("um texto cort…") == "um texto cort" and E.peel("um texto cort [...]\n") == "um texto cort"
    assert E.peel("fim.") == "fim." and E.peel("…" * 500) == "" and E.peel("") == ""


Q = "Qual é o prazo para revisar o contrato anual do operador?"


@pytest.fixture(scope="module")
def words(spark, data):
    """Dictionaries from the next larger tables: real labels, some of them wrong."""
    return A.learn_words(spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet"), "text", "lang")


@pytest.mark.parametrize(
    ("answer", "label"),
    [
        (None, "empty"), ("", "empty"), (" ​", "empty"), ("N/A", "empty"), ("<p></p>", "empty"), ("{}", "empty"), ("Resposta:", "empty"), ('{"answer": ""}', "empty"), ("—", "empty"),
        (Q, "copy"), (Q.upper(), "copy"), ("Resposta: " + Q, "copy"), ("> " + Q, "copy"), (Q + " " + Q, "copy"), ("é o prazo para revisar o contrato anual do operador.", "copy"), ("Qual e o prazo para revisar o contrato anual do operador", "copy"),
        ("Infelizmente, não posso responder a esta pergunta.", "refusal"), ("I'm sorry, but I cannot answer this.", "refusal"), ("Lo siento, no puedo responder a esa pregunta.", "refusal"), (f"Não encontrei base para responder ({Q[:-1]}).", "refusal"),
        ("The operator must review the contract within 30 days of the notice.", "other_language"), ("El operador deberá revisar el contrato en un plazo de 30 días hábiles según la norma.", "other_language"),
        ("O operador deverá revisar o contrato no prazo de", "truncated"), ("O operador deverá revisar o contrato (conforme o", "truncated"), ("O contrato é revisto nos termos do Art.", "truncated"),
        ('{"answer": "O operador deverá revisar o contra', "truncated"), ('{"answer": "O prazo é de 30 dias."}', ""), ("Hay que revisar el contrato antes de que la red entre en servicio.", "other_language"),
        ("86 dias", ""), ("Não", ""), ("Art. 21, § 8º", ""), ("Não é possível revisar o contrato sem o gerador, pois o art. 5 veda o desconto.", ""),
        ("O termo em inglês “annual dispatch” designa o período anual do contrato.", ""), ("A norma não informa o prazo, mas determina que o operador deve revisar o contrato.", ""),
        ("A resposta não pode ser fornecida com o material apresentado.", "refusal"), ("The question cannot be answered from these documents.", "refusal"),
        ("Infelizmente o prazo já terminou; o operador deve revisar o contrato em 30 dias.", ""), ("Desculpe a demora: o prazo é de 30 dias.", ""), ("A norma diz: 'não posso' é resposta vedada ao atendente.", ""),
        ("Die Frist beträgt dreißig Tage ab der Mitteilung.", "other_language"), ("Contract review takes thirty days.", "other_language"), ((Q + " ") * 6, "copy"),
        ("Quanto a o prazo para revisar o contrato anual do operador: O prazo é de 30 dias, observado o art. 9.", ""),
    ],
)
def test_defects(answer, label, words):
    assert A.defect(Q, answer, words) == label


@pytest.mark.parametrize("answer", ["O prazo de", "Conforme a", "Nos termos do", "Conforme", "O prazo e", "Sim,", "O prazo (", "CONFORME A", "Nos termos do Art."])
def test_short_cut_answers(answer, words):
    assert A.defect(Q, answer, words) == "truncated"


@pytest.mark.parametrize("answer", ["86 dias", "Sim", "Não.", "A", "e", "Letra A", "alínea e", "Opção o", "Grupo A", "Subgrupo AS", "Um", "Apenas uma", "Art. 21", "Sim (ver anexo)", "1.15", "R$ 5,00"])
def test_short_sound_answers(answer, words):
    assert A.defect(Q, answer, words) == ""


def test_language_of_questions(words):
    spanish = "¿Cuándo se debe reemplazar la auditoría según la demanda?"
    assert A.main_language(spanish, words) == "es" and A.defect(spanish, "El operador deberá revisar la auditoría en un plazo de 9 días hábiles.", words) == ""
    assert A.main_language("Quel délai faut-il pour régler la facture ?", words) == "fr" and A.main_language("Who must review the demand?", words) == "en" and A.main_language(Q, words) == "pt"


def test_learned_words(spark):
    rows = [("o prazo de revisão do contrato", "pt"), ("o prazo de revisão", "PT-br"), ("the term of the contract", " en"), ("the term of notice", "en"), (None, "pt"), ("o prazo", None), ("o", "?")]
    words = A.learn_words(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert words["prazo"] == (frozenset({"pt"}), "pt") and words["the"][1] == "en" and A.learn_words(spark.createDataFrame([], "text string, lang string"), "text", "lang") == {}
    assert A.defect(Q, "O prazo é de 30 dias.", {}) == ""  # without dictionaries no answer is foreign


def test_pairs_in_spark(spark, words):
    rng = random.Random(2)
    rows = [(i, f"{Q} {i % 40}", sentence(rng) + " " + sentence(rng)) for i in range(600)]
    for i in range(30):  # cut inside a word of the second half
        text = sentence(rng) + " " + sentence(rng)
        at = rng.choice([p for p in range(len(text) // 2, len(text) - 3) if text[p - 1 : p + 1].isalpha()])
        rows.append((1000 + i, f"{Q} {i % 40}", text[:at]))
    rows += [(2000, Q, None), (2001, None, "O prazo é de 30 dias."), (2002, None, None), (2003, Q, Q), (2003, Q, Q)]
    df = spark.createDataFrame([(i, q, (a,), a, "clash") for i, q, a in rows], "sample_id long, question string, out struct<a:string>, other string, side string")
    got = A.find_defects(df, "sample_id", "question", {"generated": "out.a", "expected": "other"}, words).collect()
    label = {(r.sample_id, r.side): r.defect for r in got}
    assert label[(2000, "generated")] == "empty" and label[(2002, "expected")] == "empty" and label[(2003, "expected")] == "copy"
    assert sum(r.sample_id == 2003 for r in got) == 4
    assert sum(label.get((1000 + i, "generated")) == "truncated" for i in range(30)) >= 27
    assert sum((i, "generated") in label for i in range(600)) <= 12
    assert A.find_defects(df.limit(0), "sample_id", "question", {"generated": "out.a"}, words).count() == 0
