"""Run-length encoded rows: a bit mask says which columns repeat the row before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def encode_repeats(df: DataFrame, page: str, pos: str, columns: list[str]) -> DataFrame:
    """``page, pos, mask, vals``: bit i is set where column i repeats the row
    before it; the other columns' values are listed."""
    w = Window.partitionBy(page).orderBy(pos)
    same = [F.coalesce(F.lag(c).over(w).eqNullSafe(F.col(c)) & (F.row_number().over(w) > 1), F.lit(False)) for c in columns]
    flagged = df.select(page, pos, *columns, *(s.alias(f"_same{i}") for i, s in enumerate(same)))
    mask = sum((F.when(F.col(f"_same{i}"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(columns))), F.lit(0))
    kept = F.filter(F.array(*(F.struct((~F.col(f"_same{i}")).alias("new"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns))), lambda x: x["new"])
    return flagged.select(page, pos, mask.cast("int").alias("mask"), F.transform(kept, lambda x: x["v"]).alias("vals"))


def decode_repeats(encoded: DataFrame, page: str, pos: str, columns: list[str]) -> DataFrame:
    """The rows again. A column takes the next value of the list, or, where its
    bit is set or the list is used up, that of the last row that had one; null
    values count as values."""
    w = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for i, c in enumerate(columns):
        used = F.bit_count(F.bitwise_not("mask").bitwiseAND(F.lit((1 << i) - 1)))
        fresh = (F.col("mask").bitwiseAND(F.lit(1 << i)) == 0) & (used < F.size("vals"))
        held = F.when(fresh, F.struct(F.try_element_at("vals", (used + 1).cast("int")).alias("v")))
        out.append(F.last(held, ignorenulls=True).over(w)["v"].alias(c))
    return encoded.select(page, pos, *out)
