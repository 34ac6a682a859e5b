"""HTML to text and Markdown, and the links of a page, as column expressions."""

from __future__ import annotations

import json
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.keys import strip

# Elements whose content is no text.
DROPPED = ("script", "style", "nav", "header", "footer")
# The entities that most pages have only.
COMMON = (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
# Named entities of one character, from the standard library's table.
_NAMED = {name.rstrip(";"): char for name, char in entities.html5.items() if len(char) == 1 and name != "amp;" and name != "amp"}
FORMATS = ((r"(?i)\.pdf$", "pdf"), (r"(?i)\.docx?$", "docx"), (r"(?i)\.xlsx?$", "xlsx"), (r"(?i)\.html?$", "html"))
MIN_PARAGRAPH, GOOD_TEXT = 10, 1000


def unescape(text: Column) -> Column:
    """Named and numbered entities as their characters; unknown ones stay.
    Texts with common ones only take a shorter way to the same."""
    plain = text
    for entity, char in COMMON:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    others = r"&(?!(?:nbsp|lt|gt|quot|#39|amp);)(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
    return F.when(text.rlike(others), _unescape_all(text)).otherwise(plain)


def _unescape_all(text: Column) -> Column:
    names = F.from_json(F.lit(json.dumps(_NAMED, ensure_ascii=False)), "map<string,string>")
    # What lies between entities alternates with the entities themselves.
    entity = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
    between, found = F.split(text, entity, -1), F.regexp_extract_all(text, F.lit(entity), 0)

    def char(e: Column) -> Column:
        name = F.substring(e, 2, 40)
        name = F.substring(name, F.lit(1), F.length(name) - 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10).cast("int")).when(name.startswith("#"), F.substring(name, 2, 9).cast("int"))
        point = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(name == "amp", "&").when(valid, point).otherwise(F.coalesce(F.try_element_at(names, name), e))

    whole = F.zip_with(between, found, lambda b, e: F.concat(F.coalesce(b, F.lit("")), F.coalesce(char(e), F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(whole, "")).otherwise(text)


def without_furniture(html: Column) -> Column:
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return html


def paragraphs(html: Column) -> Column:
    """Texts of the paragraphs of more than ten characters."""
    raw = F.regexp_extract_all(without_furniture(html), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    texts = F.transform(raw, lambda p: strip(unescape(F.regexp_replace(p, r"<[^>]*>", ""))))
    return F.filter(texts, lambda t: F.length(t) > MIN_PARAGRAPH)


def html_text(html: Column) -> Column:
    return F.array_join(paragraphs(html), "\n\n")


def html_quality(text: Column) -> Column:
    return F.when(F.length(text) > GOOD_TEXT, 1.0).otherwise(0.5)


def html_markdown(html: Column) -> Column:
    """Headings, list items, bold, italics and line breaks; links and images dropped."""
    t = without_furniture(html)
    t = F.regexp_replace(t, r"(?is)<img\b[^>]*>", "")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    t = F.regexp_replace(t, r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "**$1**")
    t = F.regexp_replace(t, r"(?is)<(?:i|em)>(.*?)</(?:i|em)>", "_$1_")
    t = F.regexp_replace(t, r"(?is)<li\b[^>]*>", "\n  * ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "  \n")
    t = F.regexp_replace(t, r"(?i)</?p\b[^>]*>", "\n\n")
    t = unescape(F.regexp_replace(t, r"<[^>]*>", ""))
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def links(html: Column, base: Column | None = None) -> Column:
    """``array<struct<href, title>>`` of the links, without fragments and empty
    ones; the address in double, single or no quotes, absolute if ``base``, the
    page's own address, is given."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*\bhref\s*=[^>]*>.*?</a>)"), 1)
    address = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""

    def made(a: Column) -> Column:
        href = strip(unescape(F.concat(*(F.coalesce(F.regexp_extract(a, address, g), F.lit("")) for g in (1, 2, 3)))))
        title = strip(unescape(F.regexp_replace(F.regexp_extract(a, r"(?is)<a\b[^>]*>(.*?)</a>", 1), r"<[^>]*>", "")))
        return F.struct((href if base is None else absolute(href, base)).alias("href"), title.alias("title"), href.startswith("#").alias("own"))

    found = F.filter(F.transform(whole, made), lambda x: (x["href"] != "") & ~x["own"])
    return F.transform(found, lambda x: F.struct(x["href"].alias("href"), x["title"].alias("title")))


def absolute(href: Column, base: Column) -> Column:
    """An address seen from a page: with a scheme as it is, from the host's or the folder's root otherwise."""
    host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path.rlike(r"^[^/]*//[^/]*$"), F.concat(host, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (
        F.when((href == "") | href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(host, href))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^\./", "")))
    )


def file_format(url: Column) -> Column:
    """By the extension, whatever the query string; null if unknown."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    out = None
    for pattern, name in FORMATS:
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return out


def decode_bytes(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes aren't valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def is_pdf(content: Column) -> Column:
    """Long enough and with a PDF's first bytes."""
    return (F.octet_length(content) > 1000) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))
