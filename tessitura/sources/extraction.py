"""Text of binary files: a registry of extractors over ``binaryFile`` rows.

HTML is read by column expressions.  Other formats go through parsers that
their user registers, by format and output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions import html as H

#: Parsers by (format, output); empty until some are registered.
EXTRACTORS: dict[tuple[str, str], Callable[[bytes], str]] = {}


def extract(files: DataFrame, output: str, extractors: dict[tuple[str, str], Callable[[bytes], str]] | None = None) -> DataFrame:
    """``path, formato, texto, qualidade_extracao, erro`` of ``binaryFile`` rows.

    A format that has no parser for the output, and a file whose parser fails,
    give a null text and an error; an unknown output is an error at once.
    """
    if output not in ("texto", "markdown"):
        raise ValueError(f"unknown output {output}")
    known = dict(EXTRACTORS if extractors is None else extractors)
    named = files.select("path", H.file_format(F.lower("path")).alias("formato"), "content")
    page = H.decode_bytes(F.col("content"))
    text = H.html_text(page) if output == "texto" else H.html_markdown(page)
    html = named.where("formato = 'html'").select("path", "formato", text.alias("texto"), F.lit(None).cast("string").alias("erro"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in batch[["path", "formato", "content"]].itertuples(index=False):
                parser = known.get((kind, output))
                if parser is None:
                    rows.append((path, kind, None, "unknown format"))
                    continue
                try:
                    rows.append((path, kind, parser(content), None))
                except Exception as e:
                    rows.append((path, kind, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "formato", "texto", "erro"])

    others = named.where("formato is null or formato <> 'html'").mapInPandas(run, "path string, formato string, texto string, erro string")
    return html.unionByName(others).withColumn("qualidade_extracao", F.when(F.col("texto").isNotNull(), H.html_quality(F.col("texto"))))
