"""Defects of question and answer pairs.

Copies are found by compressing the answer with its question as a zstandard
dictionary: what the compressed answer still holds is what the question
doesn't.  The language dictionaries are learned from labelled texts: the words
of each language, and which of them are its own.  The refusal dictionary holds
what a first person says of its own inability, and what is said of an answer
that can't be given; a clause of an answer must say it.  What is left is judged
by the end-of-text model, trained on the answers themselves, with a share of
cut answers for each number of words.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.llm.endings import cut_scores
from tessitura.session import materialize

#: Bytes that a copy may add to its question, and the share of the question it must repeat.
NEW_BYTES, REPEATED_SHARE = 26, 0.6
#: Languages that are learned, the most labelled ones, and words of each, the most frequent ones.
LANGUAGES, WORDS = 40, 20_000
#: A word is a language's own if that much of its use, in equally many words of each, is there.
OWN_SHARE = 0.8
#: Words of another language, beyond twice those of the question's, that make an answer foreign.
LEAST_FOREIGN = 2
#: An answer is foreign, too, if it has so many plain words and the question's language knows a smaller share of them.
LEAST_PLAIN, KNOWN_SHARE = 4, 0.3
#: Numbers of words that are classes of their own in the end-of-text model.
SHORT_CLASSES = 4

# What stands for an answer without being one, letters and digits only.
FILLERS = frozenset(
    "na nd null none nan nil vazio vazia empty semresposta resposta noanswer answer undefined tbd todo semdados nodata "
    "naodisponivel naoinformado indisponivel pendente adefinir aguardando respuesta sinrespuesta reponse sansreponse blank xxx".split()
)

# Expressions of refusal without accents, in lower case; by language, first of one's own inability, then of the answer's.
REFUSALS = re.compile(
    r"\b(?:"
    r"nao (?:posso|consigo|sei|devo|vou|tenho (?:como|acesso|dados|informac|condic|elementos|base|meios)|disponho|encontrei|encontro|localizei|localizo|achei|(?:fui|sou) capaz|estou (?:apt|autorizad|em condic|habilitad)|me (?:foi|e|seria) (?:possivel|permitido|dado))"
    r"|(?:deixo|abstenho-me|me abstenho|recuso-me|me recuso|declino|evito|prefiro nao|preferiria nao) |(?:fico|estou|sinto-me|vejo-me) (?:impossibilitad|impedid|incapa)|me faltam?\b|faltam?-me|foge (?:ao?|do) (?:que me|meu|minha)|fora d[oa] (?:meu|minha)\b|d[ae] minha (?:parte|competencia|alcada)"
    r"|(?:resposta|pergunta|questao|consulta|solicitacao|pedido)\b[^.;!?]{0,60}\bnao (?:pode|podera|podem|sera|foi|pude|esta)\b[^.;!?]{0,20}(?:respond|forneci|dad[oa]|atendi|localiza|encontra|determina|dispon)"
    r"|nao (?:e|foi|sera|seria|ha) (?:possivel|viavel|como|meio de) (?:responder|localizar a resposta|fornecer|dar|atender|ajudar|esclarecer|opinar)|nao permitem? (?:responder|dar|uma resposta|concluir)"
    r"|nao ha (?:base|dados|elementos|informac\w*|contexto)(?: suficientes?)? para (?:responder|dar|uma|esclarecer)|nada n[oa]s? (?:contextos?|trechos?|documentos?|material|textos?)\b[^.;!?]{0,40}\b(?:trata|responde|menciona|permite|diz|consta)|so um especialista"
    r"|i(?: am|'m) (?:unable|not able|not allowed|afraid i|sorry,? (?:but )?i)|i (?:cannot|can't|can not|could not|couldn't|do not have|don't have|do not know|don't know|must decline|decline|would rather not|prefer not)"
    r"|(?:question|answer|request)\b[^.;!?]{0,40}\b(?:cannot|can't|could not) be (?:given|answered|provided|found|met)|unable to (?:answer|provide|help|respond)|cannot (?:answer|help|assist)|not enough (?:information|context|data) to (?:answer|respond)"
    r"|no (?:puedo|dispongo|tengo (?:acceso|datos|informacion|elementos)|encontre|encuentro|me (?:es|fue) posible|soy capaz|estoy en condic)|me (?:es imposible|abstengo|niego)|prefiero no"
    r"|(?:respuesta|pregunta|consulta|solicitud)\b[^.;!?]{0,40}\bno (?:puede|se puede|pudo)\b|no (?:es|fue) posible (?:responder|contestar|ayudar)"
    r"|je (?:ne (?:peux|puis|sais|dispose|trouve|suis pas)|n'ai (?:pas|trouve)|prefere ne|refuse|regrette de ne)|il (?:m'est|est) impossible de (?:repondre|fournir)"
    r")"
)

# Words that an answer can't end with, and abbreviations that wait for a number.
OPEN_WORDS = frozenset(
    "o a os as ao aos à às do da dos das de em no na nos nas e ou que com por para pelo pela pelos pelas um uma se sem sob sobre entre conforme quando seu sua "
    "the of and or to in an by at for from with which whose el la los las del al y en un una con sin según le les la du des et ou dans par pour sur".split()
)
# Of short answers: numbers in words and what may stand before them, and what a letter names.
NUMBER_WORDS, LIMITS = frozenset("um uma un".split()), frozenset("apenas só somente exatamente menos máximo mínimo".split())
LABELLED = frozenset("letra alínea alinea opção opcao alternativa item grupo subgrupo classe anexo tipo nível categoria option letter group class".split())
OPEN_SHORT = frozenset("art. arts. nº n.º inc. § p. ex. al.".split())

_TAG = re.compile(r"<[^<>]{0,200}>")
_QUOTED = re.compile(r"[“\"«][^”\"»]{0,200}[”\"»]|(?<!\w)['‘][^'’]{0,200}['’](?!\w)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def unwrapped(answer: str) -> str:
    """The answer inside a JSON object, if it is (or begins as) one."""
    text = answer.strip()
    if not text.startswith("{"):
        return answer
    try:
        held = json.loads(text)
        if isinstance(held, dict):
            return next((v for v in held.values() if isinstance(v, str)), "")
    except ValueError:
        pass
    m = re.match(r'\{\s*"\w+"\s*:\s*"', text)
    return text[m.end() :] if m else answer


def is_broken_object(answer: str | None) -> bool:
    """Begins as a JSON object that isn't closed."""
    text = (answer or "").strip()
    if not re.match(r'\{\s*"', text):
        return False
    try:
        json.loads(text)
        return False
    except ValueError:
        return not text.endswith("}")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    left = re.sub(r"[\W_]+", "", plain(_TAG.sub("", answer).replace("&nbsp;", " ")))
    return not left or left in FILLERS


@lru_cache(maxsize=4096)
def _packer(question: str) -> zstandard.ZstdCompressor:
    # Raw content dictionaries have eight bytes at least.
    held = zstandard.ZstdCompressionDict(question.encode("utf-8", "surrogatepass").ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=6, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)


def new_bytes(question: str, answer: str) -> int:
    """Bytes of the answer, compressed with the question as its dictionary; 10
    to 13 of them are the frame and a match."""
    return len(_packer(question).compress(answer.encode("utf-8", "surrogatepass")))


def _flat(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", plain(text)))


def is_copy(question: str | None, answer: str) -> bool:
    """Holds hardly anything that the question doesn't, and most words of the question."""
    q, a = _flat(question or ""), _flat(_TAG.sub("", answer))
    if len(q) < 8 or new_bytes(q, a) > NEW_BYTES:
        return False
    asked, given = q.split(), set(a.split())
    return sum(w in given for w in asked) >= REPEATED_SHARE * len(asked)


def is_refusal(answer: str) -> bool:
    """Quotations refuse nothing."""
    return bool(REFUSALS.search(plain(_QUOTED.sub(" ", answer.replace("’", "'")))))


#: Of each word the languages that have it, and the one whose own it is or ''.
Words = dict[str, tuple[frozenset[str], str]]
_NONE = (frozenset(), "")


def learn_words(df: DataFrame, text_col: str, lang_col: str) -> Words:
    """The words of the ``LANGUAGES`` most labelled languages, ``WORDS`` of each
    at most, counted over all labelled texts. A label's first two letters say
    the language; wrong labels do no harm while they are few."""
    lang = F.lower(F.substring(F.trim(df[lang_col]), 1, 2))
    texts = df.select(lang.alias("lang"), df[text_col].alias("text")).where("lang rlike '^[a-z]{2}$' and text is not null")
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:['’-]\p{L}+)*"), 0)).alias("word")
    counts = texts.select("lang", words).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(LANGUAGES)
    rate = counts.join(totals, "lang").select("lang", "word", "n", (F.col("n") / F.col("total")).alias("rate"))
    share = F.col("rate") / F.sum("rate").over(Window.partitionBy("word"))  # a word has LANGUAGES rows at most
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = rate.withColumn("share", share).withColumn("r", F.row_number().over(top)).where(F.col("r") <= WORDS)
    known: Words = {}
    sets: dict[frozenset, frozenset] = {}
    for lang, word, share in kept.select("lang", "word", "share").toPandas().itertuples(index=False):  # LANGUAGES x WORDS rows at most
        held, own = known.get(word, _NONE)
        held = held | {lang}
        known[word] = (sets.setdefault(held, held), lang if share >= OWN_SHARE else own)
    return known


def language(text: str, words: Words) -> dict[str, int]:
    """How many words of the text are each language's own; quotations don't count."""
    score: dict[str, int] = {}
    for word in _WORD.findall(_QUOTED.sub(" ", text.lower())):
        if own := words.get(word, _NONE)[1]:
            score[own] = score.get(own, 0) + 1
    return score


def main_language(text: str, words: Words) -> str:
    """The language with most words, or '' when none is ahead."""
    best = sorted(language(text, words).items(), key=lambda x: -x[1])[:2]
    return best[0][0] if len(best) == 1 or len(best) == 2 and best[0][1] > best[1][1] else ""


def is_unknown(text: str, lang: str, words: Words) -> bool:
    """Whether the language doesn't have the text's words; names, in capitals, and numbers don't count."""
    small = [w for w in _WORD.findall(_QUOTED.sub(" ", text)) if w == w.lower() and len(w) > 1]
    return len(small) >= LEAST_PLAIN and sum(lang in words.get(w, _NONE)[0] for w in small) < KNOWN_SHARE * len(small)


def is_other_language(question: str | None, answer: str, words: Words) -> bool:
    asked = main_language(question or "", words)
    if not asked:
        return False
    score = language(answer, words)
    best = max(score, key=score.get, default=asked)
    return best != asked and score[best] >= 2 * score.get(asked, 0) + LEAST_FOREIGN or is_unknown(answer, asked, words)


def is_label(words: list[str], whole: str) -> bool:
    """Whether a short answer's last word, though in ``OPEN_WORDS``, is a value:
    a letter alone, named or a capital among small ones, or a number in words."""
    last, before = words[-1], words[-2].lower() if len(words) > 1 else ""
    if last.lower() in NUMBER_WORDS:
        return not before or before in LIMITS
    return before in LABELLED or (last.isupper() and not whole.isupper()) or (not before and len(last) == 1)


def is_left_open(answer: str) -> bool:
    """Ends with a word, sign or bracket that something was to follow."""
    text = answer.rstrip()
    words = text.split()
    if not words:
        return False
    last = words[-1].lower()
    if last.lstrip("([“\"") in OPEN_WORDS and not (len(words) < SHORT_CLASSES and is_label(words, text)):
        return True
    return last in OPEN_SHORT or text[-1] in ",(" or text.rfind("(") > max(text.rfind(")"), len(text) - 40)


def defect(question: str | None, answer: str | None, words: Words) -> str:
    """The defect that needs no end-of-text model, or '': of cut answers those
    that an unclosed object, an open word or bracket gives away, which many of
    them share so that the model takes them for ends."""
    broken = is_broken_object(answer)
    answer = unwrapped(answer) if answer else answer
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if is_other_language(question, answer, words):
        return "other_language"
    return "truncated" if broken or is_left_open(answer) else ""


def _labelled(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, tuple] = {}
    for batch in batches:
        rows = []
        for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if pair not in known:
                if len(known) > 50_000:
                    known.clear()
                label = defect(*pair, words)
                known[pair] = (label, None, None) if label else ("", unwrapped(pair[1]), main_language(pair[1], words))
            rows.append(known[pair])
        labels, texts, langs = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(labels, pa.string()), pa.array(texts, pa.string()), pa.array(langs, pa.string())],
            names=["item", "side", "question", "defect", "answer", "lang"],
        )


def find_defects(df: DataFrame, item_col: str, question_col: str, answer_cols: dict[str, str], words: Words) -> DataFrame:
    """``item_col, side, defect`` of each defective pair, at most one per pair.

    ``answer_cols`` names the answer's column (or struct field) by side,
    ``words`` are the languages (``learn_words``).  Defects in the order they
    are looked for: ``empty`` (null, blank, filler, placeholder or bare
    markup), ``copy``, ``refusal``, ``other_language``, ``truncated``.  With a
    null or blank question an answer can't be a copy nor in another language;
    repeated rows are rows of their own; an empty table gives no rows.
    """
    kind = df.schema[item_col].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(words)
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("answer")) for s, c in answer_cols.items()))
    pairs = df.select(F.col(item_col).alias("item"), F.col(question_col).alias("question"), F.explode(sides).alias("p")).select("item", "p.side", "question", "p.answer")
    run = lambda batches: _labelled(batches, held.value)
    labelled = materialize(pairs.mapInArrow(run, f"item {kind}, side string, question string, defect string, answer string, lang string"), "answers")
    key = F.xxhash64("question", "answer")
    sound = labelled.where("defect = ''").select("item", "side", "question", "answer", "lang", key.alias("pair"))
    # Each pair is one text of the model, however many rows repeat it; short answers have a share of cuts by their number of words.
    size = F.least(F.size(F.split(F.trim("answer"), r"\s+")), F.lit(SHORT_CLASSES)).alias("size")
    pairs = sound.select("pair", "question", "answer", "lang", size).dropDuplicates(["pair"])
    cut = cut_scores(pairs, "pair", "answer", "lang", "size", "question").where(F.col("log_odds") > 0).select(F.col("item").alias("pair"))
    truncated = sound.select("item", "side", "pair").join(cut, "pair", "left_semi").select("item", "side", F.lit("truncated").alias("defect"))
    found = labelled.where("defect <> ''").select("item", "side", "defect").unionByName(truncated)
    return found.withColumnRenamed("item", item_col)
