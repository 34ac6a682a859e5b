"""Text functions on columns: tokens, normalisation, legal markers, signatures.

All are built-in expressions, so they stay in the JVM.  White space means what
Unicode calls so, not only ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x85\x1c-\x1f]"

# Accented letters and what they are folded to.
ACCENTED = "áàâãäåāăąçćčďéèêëēęěíìîïīñńňóòôõöōőřśşšťúùûüūůűýÿźżžºª"
FOLDED = "aaaaaaaaacccdeeeeeeeiiiiinnnooooooorssstuuuuuuuyyzzzoa"

# Words that carry no information, and short domain terms that do.
STOP_WORDS = (
    "a o os as um uma uns umas de da do das dos e em no na nos nas por para com sem sob sobre entre que se ao aos à às é são ser foi foram "
    "como qual quais quanto quando onde segundo antes depois este esta esse essa isso sua seu suas seus pela pelo pelas pelos mais menos ou também não"
).split()
SHORT_TERMS = "dec fec dic fic dmic ren reh res ons te pch ena ear gsf pis kv kw mwh gwh".split()

# Patterns of legal structure.
ARTICLE = r"(?imud)^[\s\p{Z}\x85\x1c-\x1f]*(?:#{1,6}[\s\p{Z}]*)?(?:\*\*)?[\s\p{Z}]*((?:Art\.?|Artigo)[\s\p{Z}]*\d+[º°o]?(?:-[A-Z])?)"
PARAGRAPH = r"(?iu)(§[\s\p{Z}]*\d+[º°o]?)"
INCISO = r"(?iu)(?:^|[\s\p{Z}])([IVXLCDM]+)[\s\p{Z}]*[-–]"
ALINEA = r"(?iu)(?:^|[\s\p{Z}])([a-z])\)"
SECTION = r"(?imud)^[\s\p{Z}]*((?:T[IÍ]TULO|CAP[IÍ]TULO|SE[CÇ][AÃ]O|M[ÓO]DULO|SUBM[ÓO]DULO)[\s\p{Z}]+[^\n]+)"
HEADING = r"(?md)^[ \t]*#{1,6}[ \t]+[^\s\p{Z}]"
QUERY_MODULE = r"(?iu)subm[óo]dulo[\s\p{Z}]+(\d+)\.(\d+)([a-z]?)(?:-([a-z]+))?"
MODULE_KEY = r"(?i)subm(\d+-\d+[a-z]?)(?=-)"
VERSION = r"(?i)-v-(\d+)-(\d+)([a-z]?)(?:-|$)"
OFFICIAL = r"(?i)-(?:aren|adsp)\d+"
IDENTIFIERS = (
    r"(?iu)(REN[\s\p{Z}]+[\d.]+/\d{4})",
    r"(?iu)(PRORET[\s\p{Z}]+Subm[óo]dulo[\s\p{Z}]+[\d.]+)",
    r"(?iu)(PRODIST[\s\p{Z}]+M[óo]dulo[\s\p{Z}]+\d+)",
    r"(?iu)(Lei[\s\p{Z}]+[\d.]+/\d{4})",
    r"(?iu)(Despacho[\s\p{Z}]+[\d.]+/\d{4})",
)


def words(text: Column) -> Column:
    """White-space separated words; null gives null."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def collapse(text: Column) -> Column:
    """White space made single blanks."""
    return F.array_join(words(text), " ")


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match with its white space collapsed; null without one."""
    return or_null(collapse(F.regexp_extract(text, pattern, group)))


def fold(text: Column) -> Column:
    """Lower case without accents, whether composed or combining."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, FOLDED), r"\p{M}+", "")


def normalized(text: Column) -> Column:
    """Lower case, accents folded, everything else than letters and digits one blank."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def informative(text: Column, stop: list[str] | None = None, short: list[str] | None = None) -> Column:
    """Normalised words that carry information, repeats kept."""
    stops = F.array(*map(F.lit, STOP_WORDS if stop is None else stop))
    terms = F.array(*map(F.lit, SHORT_TERMS if short is None else short))
    keep = lambda w: (w != "") & ~F.array_contains(stops, w) & ((F.length(w) >= 4) | F.array_contains(terms, w))
    return F.filter(F.split(normalized(text), " "), keep)


def coverage(needle: Column, haystack: Column, empty: float) -> Column:
    """Share of the needle's words, with repeats, that the haystack has."""
    held = F.filter(needle, lambda w: F.array_contains(haystack, w))
    return F.when(F.size(needle) == 0, F.lit(empty)).otherwise(F.size(held) / F.size(needle))


def citation_label(title: Column, document: Column, article: Column, paragraph: Column, inciso: Column, alinea: Column, index: Column) -> Column:
    parts = F.concat_ws(
        ", ", F.coalesce(or_null(title), document), or_null(article), or_null(paragraph),
        F.concat(F.lit("inciso "), or_null(inciso)), F.concat(F.lit("alinea "), or_null(alinea)),
    )
    bare = F.coalesce(or_null(article), or_null(paragraph), or_null(inciso), or_null(alinea)).isNull()
    return F.when(bare, F.concat(parts, F.lit(", chunk "), index.cast("string"))).otherwise(parts)


def _dotted(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws(".", *(F.concat(F.lit(prefix), or_null(F.lower(value))) for prefix, value in parts))


def chunk_signature(article: Column, paragraph: Column, inciso: Column, alinea: Column) -> Column:
    """``art1.par1.incii.alia`` from the structured fields; '' without any."""
    one = lambda c, p: F.regexp_extract(F.coalesce(c, F.lit("")), p, 1)
    return _dotted(("art", one(article, r"(\d+)")), ("par", one(paragraph, r"(\d+)")), ("inc", one(inciso, r"(?i)([ivxlcdm]+)")), ("ali", one(alinea, r"(?i)([a-z])")))


def label_signature(label: Column) -> Column:
    """The same from a citation label."""
    one = lambda p: F.regexp_extract(F.coalesce(label, F.lit("")), p, 1)
    return _dotted(
        ("art", one(r"(?iu)art\.?[\s\p{Z}]*([0-9]+(?:[.\-][0-9]+)?)")),
        ("par", one(r"(?iu)(?:§|paragrafo|paragraph)[\s\p{Z}]*([0-9]+)")),
        ("inc", one(r"(?iu)inciso[\s\p{Z}]+([ivxlcdm0-9]+)")),
        ("ali", one(r"(?iu)al[ií]nea[\s\p{Z}]+([a-z])")),
    )


def signatures_match(a: Column, b: Column) -> Column:
    """One begins the other at a dot, or both are equal; an empty one never matches."""
    return (a != "") & (b != "") & ((a == b) | F.startswith(b, F.concat(a, F.lit("."))) | F.startswith(a, F.concat(b, F.lit("."))))


def grade(relevance: Column) -> Column:
    """Relevance between 1 and 3; 1 where missing or zero."""
    return F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(F.nullif(relevance.cast("int"), F.lit(0)), F.lit(1))))


def query_module(query: Column) -> Column:
    """``2-1a`` or ``5-1-op`` of the submodule a query names; null without one."""
    g = [F.lower(F.regexp_extract(query, QUERY_MODULE, i)) for i in range(1, 5)]
    return F.when(g[0] != "", F.concat(g[0], F.lit("-"), g[1], g[2], F.when(g[3] != "", F.concat(F.lit("-"), g[3])).otherwise("")))


def module_key(document: Column) -> Column:
    return or_null(F.lower(F.regexp_extract(document, MODULE_KEY, 1)))


def version(document: Column) -> Column:
    """``struct<major int, minor int, suffix string>`` of a versioned id; null without one."""
    g = [F.regexp_extract(document, VERSION, i) for i in range(1, 4)]
    return F.when(g[0] != "", F.struct(g[0].try_cast("int").alias("major"), g[1].try_cast("int").alias("minor"), F.lower(g[2]).alias("suffix")))


def matches_module(document: Column, module: Column) -> Column:
    """Whether an id is of a submodule: not a longer number, not a version."""
    long = F.size(F.split(module, "-")) >= 3
    prefix = F.when(long, F.lit(r"(?:rede-|s-bmodulo-)")).otherwise(F.lit(r"(?:subm|rede-)"))
    return F.coalesce((module != "") & F.rlike(F.lower(document), F.concat(prefix, module, F.lit("(?![0-9a-z])"))), F.lit(False))


def identifiers(text: Column) -> Column:
    """Identifiers that a text names, normalised, in order, each once."""
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in IDENTIFIERS]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.lower(collapse(x))))


def slug(text: Column, longest: int = 80) -> Column:
    plain = F.regexp_replace(F.translate(F.lower(text), ACCENTED[:-2], FOLDED[:-2]), r"\p{M}+", "")
    made = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(or_null(F.substring(made, 1, longest)), F.lit("documento"))


def preview(text: Column, longest: int = 180) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= longest, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, longest - 3)), F.lit("...")))


def plain_text(raw: Column, text: Column) -> Column:
    """The raw text, or the other where there is none, without outer white space; '' without both."""
    edge = rf"^{SPACE}+|{SPACE}+$"
    return F.regexp_replace(F.coalesce(or_null(raw), text, F.lit("")), edge, "")


def path_id(path: Column) -> Column:
    """An id of a path or URL: its last part without extension and query, as a slug."""
    name = F.element_at(F.split(F.regexp_replace(path, r"[?#].*$", ""), r"[/\\]"), -1)
    return slug(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""))


def cited_indices(answer: Column, n: Column) -> Column:
    """The numbers of ``[i]`` in an answer between 1 and ``n``, each once, in order."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda i: (i >= 1) & (i <= n)))


def finite(value: Column) -> Column:
    """Null for what is no number."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def chunk_id(document: Column, method: Column, strategy: Column, index: Column) -> Column:
    return F.format_string("%s::%s::%s::%04d", document, method, strategy, index)


def index_of_chunk(chunk: Column) -> Column:
    return F.coalesce(F.element_at(F.split(chunk, "::"), -1).try_cast("int"), F.lit(-1))


# What a very short chunk is: the first class of which its collapsed text meets all patterns.
NOISE = (
    ("marcador_imagem_omitida", ("(?i)picture", "(?i)omitted")),
    ("tabela_markdown", (r"\|", "---|<[bB][rR]>")),
    ("numero_pagina", (r"(?i)(?:^|[^\p{L}\p{N}_])p[áa]g(?:ina)?\.?\s*\d+(?:[^\p{L}\p{N}_]|$)|^\**\s*\d+\s*/\s*\d+\s*\**$",)),
    ("url_footer", (r"(?i)https?://|www\.",)),
    ("cabecalho_isolado", (r"^(?:#+\s*)?(?:\*\*)?(?:\d+(?:\.\d+)+|[A-ZÁÉÍÓÚÇ ]{4,})",)),
    ("fragmento_referencia_cruzada", (r"(?i)^art\.?\s*\d+[º°o]?(?:-[a-z])?\s+(?:na|no|da|do)(?:[^\p{L}\p{N}_]|$)",)),
    ("item_lista_curto", (r"^-?\s*\(?[a-z0-9]+\)?\s*[-–)]",)),
)


def noise_class(text: Column) -> Column:
    # The text is bound by a lambda: collapsed once, not once per pattern.
    def named(line: Column) -> Column:
        met = []
        for label, patterns in NOISE:
            all_met = F.lit(True)
            for pattern in patterns:
                all_met = all_met & line.rlike(pattern if pattern.isascii() else pattern.replace("(?i)", "(?iu)"))
            met.append(F.when(all_met, label))
        return F.coalesce(*met, F.lit("outro"))

    return F.transform(F.array(collapse(text)), named)[0]


def excerpt_class(needle: Column, text: Column, share: Column) -> Column:
    """How an excerpt is found in a text, both normalised; ``share`` is the
    coverage of its informative words."""
    return (
        F.when(F.coalesce(needle, F.lit("")) == "", "NOT_FOUND")
        .when(F.contains(text, needle), "LITERAL").when(share >= 0.60, "TOKEN").when(share >= 0.30, "LOW").otherwise("NOT_FOUND")
    )


def useful_markdown(text: Column) -> Column:
    """Whether ten words of three or more letters remain without markup."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)\**==>\s*(?:picture|figura)[^<]*<==\**", " "), r"[*_`#~>|\\-]+", " ")
    return F.size(F.regexp_extract_all(bare, F.lit(r"[A-Za-zÀ-ÿ0-9]{3,}"), 0)) >= 10

