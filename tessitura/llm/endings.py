"""Texts that were cut off, by a backward character n-gram model of their ends.

Two things are counted over all texts of a column: where lines and texts end
(*ends*), and every place inside a line at which a text could have been cut
(*places*).  A context is the last characters read backward, one to
``LONGEST``, alone and together with how its line opens.  What a cut leaves
behind looks like any place; a whole text stops like other ends.  The ends that
cuts would explain are taken off, and the ratio of what remains to the places
is smoothed from short contexts to long ones: the evidence of a text's own end.

The prior is the share of cuts in a text's class, found by expectation and
maximisation: its group and language, or its group and length where far more
of the group's texts have that length (a field limit) than lengths nearby.
From each text one cut is planted at a random place; the threshold on the
log-odds of a language is the one that finds planted cuts best for what it
flags.

The tables are hashed to a fixed number of cells, so their size doesn't depend
on the data; tasks fill them and Spark adds them up in two levels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.session import materialize

LONGEST = 5
#: Numbers of characters of the contexts that are counted together with the shape of the line's first word.
JOINT = (1, 2, 3)
#: Cells (as powers of two) of: last character; with the shape of the line's first word; with that word;
#: then contexts of 1 to 5 characters; then the joint ones.
_BITS = (10, 13, 16, 13, 15, 17, 19, 20, 15, 17, 19)
_OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in _BITS])])
CELLS = int(_OFFSETS[-1])
_BLOCK = 1 << 13
_PULL = 2.0
#: Tasks whose tables are added in one group of the first level.
FAN_IN = 512
#: Characters that a task counts at once.
_CHUNK = 800_000
#: Texts that the usual share counts for in the share of a class.
_CLASS_PULL = 20.0
#: Rounds of expectation and maximisation, and bounds of a share.
_ROUNDS, _LEAST_SHARE, _MOST_SHARE = 3, 0.0005, 0.995
#: Texts that the whole column counts for in the threshold of a language; bins of a log-odds and their number.
_LANGUAGE_PULL, _BIN, _BINS = 500.0, 0.25, 49

# What may follow a cut, on the same line or the next; tags and entities that aren't closed.
_AFTER_CUT = re.compile(
    r"(?:\s|…|\.\.\.|\[\.\.\.\]|\(\.\.\.\)|\[…\]|\(…\)|\*\*|\[|�|<br ?/?>|</?[a-z][a-z0-9]{0,8}|<|&#?[a-z0-9]{1,8}"
    r"|[\[(](?:continua|cont\.?|continúa|continued|suite|more|mais|texto (?:cortado|truncado)|truncado|truncated)(?:…|\.\.\.)?[\])])+$",
    re.IGNORECASE,
)
_SPACE = " \t\r\xa0﻿​"
_PAD = "\n" * LONGEST


def language_key(lang: str | None) -> str:
    """Two letters, or '' for what doesn't begin with them: so there are at most 677."""
    key = (lang or "").strip().lower()[:2]
    return key if len(key) == 2 and key.isascii() and key.isalpha() else ""


def peel(text: str) -> str:
    """Without what may have been put after a cut."""
    while m := _AFTER_CUT.search(tail := text[-64:]):
        text = text[: len(text) - len(tail) + m.start()]
    return text


def _shape(word: str) -> str:
    """Kinds of the characters of a word, runs written once."""
    out = ""
    for c in word[:12]:
        k = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if not out.endswith(k):
            out += k
    return out


class _Openings(dict):
    """Hashes of shape and first word of a line, by that word."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        plain = re.sub(r"\d+", "9", word.lower())[:12]
        plain = plain[:5] if "://" in plain else plain
        h = self[word] = tuple(xxhash.xxh3_64_intdigest(x) & 0xFFFFFFFF for x in (_shape(word), plain))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return x ^ (x >> np.uint32(12))


def _cells(last: list[np.ndarray], shape: np.ndarray, word: np.ndarray) -> Iterator[np.ndarray]:
    """Cell numbers of the contexts of some places, table by table. ``last``
    has the codes of the last character, the one before it, and so on;
    ``shape`` and ``word`` are the hashes of the opening of each place's line."""

    def cell(table: int, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x297A2D39)) >> np.uint32(32 - _BITS[table])

    codes = last[0]
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xC0)
    head = (np.where(letter, np.uint32(97), codes) + np.uint32(1)) * np.uint32(0x9E3779B1)
    for table, key in enumerate((head, head ^ shape, (head ^ word) * np.uint32(3))):
        yield cell(table, _mix(key))
    run, joint = np.zeros(len(codes), np.uint32), []
    for n in range(1, LONGEST + 1):
        run = _mix((run ^ (last[n - 1] + np.uint32(n << 20))) * np.uint32(0x9E3779B1))
        yield cell(n + 2, run)
        if n in JOINT:
            joint.append(run)
    for k, run in enumerate(joint):
        yield cell(3 + LONGEST + k, _mix(run ^ shape * np.uint32(0x85EBCA6B)))


def _coded(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 48) & (codes <= 57)] = 57
    return codes


def _lines(text: str) -> list[str]:
    return [line.strip(_SPACE) for line in text.split("\n")]


def _opening(line: str) -> str:
    return line.split(" ", 1)[0]


def _tally(lines: list[str], shapes: list[int], words: list[int], inner: list[bool], places: np.ndarray, ends: np.ndarray) -> None:
    """Add the contexts of some lines to the tables."""
    lines = [line.lower() for line in lines]
    codes = _coded(_PAD + _PAD.join(lines))
    length = np.array([len(line) for line in lines])
    stops = np.cumsum(length + LONGEST) - 1
    place = (codes != 10) & (codes != 32)
    place[stops] = False
    at = np.flatnonzero(place)
    held = np.repeat(np.arange(len(lines)), length + LONGEST)[at]
    opening = [np.array(x, np.uint32) for x in (shapes, words)]
    end = np.flatnonzero(np.array(inner))
    for table, where, line in ((places, at, held), (ends, stops[end], end)):
        for t, cells in enumerate(_cells([codes[where - n] for n in range(LONGEST)], *(x[line] for x in opening))):
            table[int(_OFFSETS[t]) : int(_OFFSETS[t + 1])] += np.bincount(cells, minlength=1 << _BITS[t])


def _blocks(tables: dict[str, np.ndarray], total: np.ndarray | None = None) -> pa.RecordBatch:
    """The filled blocks of a task's tables as rows."""
    context = TaskContext.get()
    kinds, numbers, values = ([], [], []) if total is None else (["totals"], [0], [total.tobytes()])
    for kind, table in tables.items():
        for b in range(0, CELLS, _BLOCK):
            part = table[b : b + _BLOCK]
            if part.any():
                kinds.append(kind)
                numbers.append(b)
                values.append(part.tobytes())
    task = pa.array([(context.partitionId() if context else 0) // FAN_IN] * len(kinds), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(numbers, pa.int32()), task, pa.array(values, pa.binary())], names=["kind", "number", "part", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, ends, total = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64), np.zeros(2, np.int64)
    openings = _Openings()
    kept, shapes, words, inner, held = [], [], [], [], 0
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            lines = [x for x in _lines(peel(text or "")) if x]
            if not lines:
                continue
            # A text whose lines go on in the next line is wrapped: its lines' ends aren't ends.
            broken = sum(a[-1:].isalpha() and b[:1].islower() or a.endswith("-") for a, b in zip(lines, lines[1:]))
            wrapped = broken > 0.05 * (len(lines) - 1)
            total[0] += sum(map(len, lines)) - sum(x.count(" ") for x in lines) - len(lines)
            total[1] += 0 if wrapped else len(lines) - 1
            for i, line in enumerate(lines):
                shape, word = openings[_opening(line)]
                # A very long line is counted in pieces; only its last one ends.
                for at in range(0, len(line), _CHUNK):
                    kept.append(line[at : at + _CHUNK])
                    shapes.append(shape)
                    words.append(word)
                    inner.append(not wrapped and i + 1 < len(lines) and at + _CHUNK >= len(line))
                    held += len(kept[-1])
                    if held > _CHUNK:
                        _tally(kept, shapes, words, inner, places, ends)
                        kept, shapes, words, inner, held = [], [], [], [], 0
    if kept:
        _tally(kept, shapes, words, inner, places, ends)
    yield _blocks({"places": places, "ends": ends}, total)


def _count_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = np.zeros(CELLS, np.int64)
    for batch in batches:
        own += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=CELLS)
    yield _blocks({"own": own})


def _total(group: pa.Table, kind: type) -> pa.Table:
    total = np.zeros(len(group.column("counts")[0].as_buffer()) // 8, np.int64)
    for x in group.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.int64)
    return group.slice(0, 1).set_column(group.column_names.index("counts"), "counts", pa.array([total.astype(kind).tobytes()], pa.binary()))


def _add(group: pa.Table) -> pa.Table:
    return _total(group, np.int64)


def _add_last(group: pa.Table) -> pa.Table:
    return _total(group, np.float32)


def _summed(counted: DataFrame) -> dict[str, np.ndarray]:
    """Tables of all tasks, added in two levels; what comes to the driver has a fixed size."""
    kinds = "kind string, number int, part int, counts binary"
    some = counted.groupBy("kind", "number", "part").applyInArrow(_add, kinds)
    tables: dict[str, np.ndarray] = {}
    for b in some.groupBy("kind", "number").applyInArrow(_add_last, kinds).toLocalIterator():
        values = np.frombuffer(bytes(b["counts"]), np.float32)
        table = tables.setdefault(b["kind"], np.zeros(2 if b["kind"] == "totals" else CELLS, np.float32))
        table[b["number"] : b["number"] + len(values)] = values
    return tables


_COUNTED = "kind string, number int, part int, counts binary"


def _tail_cells(lines: list[str], openings: _Openings) -> np.ndarray:
    """Cells of the end of each line, one row per line."""
    codes = _coded("".join((_PAD + line[-LONGEST:].lower())[-LONGEST:] for line in lines)).reshape(-1, LONGEST)
    opening = np.array([openings[_opening(line)] for line in lines], np.uint32).reshape(-1, 2)
    cells = _cells([codes[:, LONGEST - 1 - n] for n in range(LONGEST)], opening[:, 0], opening[:, 1])
    return np.stack([c.astype(np.int32) + np.int32(low) for c, low in zip(cells, _OFFSETS)], axis=1)


def _last_line(text: str) -> str:
    return text[text.rfind("\n") + 1 :].strip(_SPACE)


def _planted(text: str, at: int) -> str:
    """The line that a cut after ``at`` characters leaves last; one that would fall at a line's end falls before it."""
    if text[at : at + 1] in ("", "\n", "\r"):
        at -= 1
    left = text[:at].rstrip()
    return _last_line(left) or text[:1]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its language, group, hash (with its topic), lengths, the cells of its own end and of a planted one."""
    openings = _Openings()
    for batch in batches:
        rows, tails, cuts = [], [], []
        for i, (lang, text, topic) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist())):
            text = text.as_py() or ""
            bare = peel(text)
            line = _last_line(bare)
            if not line:
                continue
            raw = text.encode("utf-8", "surrogatepass")
            h = xxhash.xxh3_64_intdigest(raw, topic or 0)
            rows.append((i, language_key(lang), h, len(text), len(raw)))
            tails.append(line)
            cuts.append(_planted(bare, 1 + h % len(bare)))
        at, keys, hashes, chars, sizes = zip(*rows) if rows else ((),) * 5
        own, planted = (_tail_cells(x, openings) for x in (tails, cuts))
        lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(_BITS), dtype=np.int32), x.ravel()) for x in (own, planted)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), batch.column(4).take(pa.array(at, pa.int64())),
                pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(chars, pa.int64()), pa.array(sizes, pa.int64()), *lists,
            ],
            names=["item", "lang", "grp", "hash", "chars", "bytes", "cells", "planted"],
        )


@dataclass
class EndModel:
    """Counts of ends and places per cell; ``usual`` is the share of cuts of all texts."""

    ends: np.ndarray
    places: np.ndarray
    scale: float
    explained: float
    usual: float

    def evidence(self, cells: np.ndarray, own: bool) -> np.ndarray:
        """Log of how much likelier the ends with these cells are after a cut than in whole texts.
        With ``own`` they were counted among the ends, else among the places."""

        def ratio(table: int, prior: np.ndarray) -> np.ndarray:
            at = cells[:, table]
            # A text's own end, and a planted place, don't speak for themselves.
            places = np.maximum(0, self.places[at] - (not own)) * self.scale
            by_cuts = self.explained * places
            ends = self.ends[at] - own - by_cuts
            ends = np.where(ends < 2 * np.sqrt(by_cuts + 0.25), 0.3 * np.maximum(0, ends), ends)
            return (ends + _PULL) / (places + _PULL / prior)

        top = ratio(0, np.ones(len(cells)))
        whole = shape = ratio(1, top)
        context = None
        for n in range(1, LONGEST + 1):
            longer = ratio(n + 2, top if context is None else context)
            if context is not None:
                whole = whole * longer / context
            if n in JOINT:
                whole = ratio(3 + LONGEST + JOINT.index(n), whole)
            context = longer
        # What the first word says beyond its shape.
        whole = whole * ratio(2, shape) / shape
        return -np.log(whole)


def fit_endings(df: DataFrame, item_col: str, text_col: str, lang_col: str, group_col: str | None = None, topic_col: str | None = None) -> tuple[EndModel, DataFrame]:
    """The model of a column, counted over all its texts, and the features of
    its texts (blank texts have none).

    Copies of a text count as one end; with ``topic_col`` those of one topic
    do, so that a text that stops alike on many topics speaks for its end."""
    topic = F.lit(0).cast("bigint") if topic_col is None else F.abs(F.hash(df[topic_col])).cast("bigint")
    group = F.lit("") if group_col is None else F.coalesce(df[group_col].cast("string"), F.lit(""))
    texts = df.select(df[item_col].alias("item"), df[lang_col].cast("string").alias("lang"), df[text_col].alias("text"), topic.alias("topic"), group.alias("grp"))
    tables = _summed(texts.select("text").mapInArrow(_count, _COUNTED))

    kind = texts.schema["item"].dataType.simpleString()
    schema = f"item {kind}, lang string, grp string, hash bigint, chars bigint, bytes bigint, cells array<int>, planted array<int>"
    features = materialize(texts.mapInArrow(_features, schema), "endings")
    own = _summed(features.groupBy("hash").agg(F.first("cells").alias("cells")).select("cells").mapInArrow(_count_own, _COUNTED)).get("own", np.zeros(CELLS, np.float32))
    places, ends, total = (tables.get(k, np.zeros(n, np.float32)) for k, n in (("places", CELLS), ("ends", CELLS), ("totals", 2)))
    total, n = total.astype(np.float64), max(1.0, own[: 1 << _BITS[0]].sum(dtype=np.float64))

    # Half of all places lie in contexts of two characters at which lines hardly
    # ever end: a text that stops there was cut.
    low, high = int(_OFFSETS[4]), int(_OFFSETS[5])
    order = np.argsort(ends[low:high] / (places[low:high] + 1), kind="stable")
    order = order[places[low:high][order] > 0]
    mass = np.cumsum(places[low:high][order], dtype=np.float64)
    inside = order[: int(np.searchsorted(mass, 0.5 * mass[-1])) + 1] if len(order) else order
    part = places[low:high][inside].sum() / max(1, places[low:high].sum())
    usual = float(np.clip(own[low:high][inside].sum() / n / max(part, 1e-9), 0.005, 0.6))
    ends += own
    model = EndModel(ends, places, (total[1] + n) / max(1.0, total[0]), usual * n / (total[1] + n), usual)
    return model, features


def _limits(distinct: DataFrame, column: str) -> DataFrame:
    """``grp, column, excess``: lengths that many more texts of a group have
    than lengths nearby, and the share of them beyond what is usual there."""
    counts = materialize(distinct.groupBy("grp", column).agg(F.count("*").alias("n")), "lengths")
    # No other count passes the test below, however few texts there are nearby.
    near = [F.lit(d) for d in range(-20, 21) if d]
    many = counts.where("n > 7").select("grp", column, "n", F.explode(F.array(*near)).alias("d"))
    beside = counts.select(F.col("grp").alias("g"), F.col(column).alias("other"), F.col("n").alias("beside"))
    joined = many.join(beside, (F.col("grp") == F.col("g")) & (F.col(column) + F.col("d") == F.col("other")), "left")
    held = joined.groupBy("grp", column, "n").agg(F.sort_array(F.collect_list(F.coalesce("beside", F.lit(0)))).alias("near"))  # 40 counts
    usual = F.aggregate(F.slice("near", 1, 36), F.lit(0).cast("bigint"), lambda x, y: x + y) / 36 + 0.5
    found = held.select("grp", column, "n", usual.alias("usual")).where(F.col("n") > F.col("usual") + 4 * F.sqrt("usual") + 4)
    return found.select("grp", column, ((F.col("n") - F.col("usual")) / F.col("n")).alias(f"{column}_excess"))


def _logit(share: Column) -> Column:
    return F.log(share / (1 - share))


def _with_priors(scored: DataFrame, usual: float) -> DataFrame:
    """``scored`` with ``prior``, the share of cuts in the class of each text:
    its group and language, or its group and the field limit it stops at."""
    distinct = scored.select("hash", "grp", "chars", "bytes").dropDuplicates(["hash", "grp"])
    for column in ("chars", "bytes"):
        scored = scored.join(_limits(distinct, column), ["grp", column], "left")
    by_chars = F.coalesce("chars_excess", F.lit(0.0)) >= F.coalesce("bytes_excess", F.lit(0.0))
    limit = F.when(F.coalesce("chars_excess", "bytes_excess").isNull(), "").when(by_chars, F.concat(F.lit("c"), "chars")).otherwise(F.concat(F.lit("b"), "bytes"))
    start = F.greatest(F.coalesce("chars_excess", F.lit(usual)), F.coalesce("bytes_excess", F.lit(usual)))
    scored = materialize(
        scored.select("item", "lang", "grp", "hash", "evidence", "planted", limit.alias("stop"), start.alias("start")), "scored"
    )
    # Each text once in its class, however often it is repeated.
    own_lang = F.when(F.col("stop") == "", F.col("lang")).otherwise("")
    single = scored.groupBy("hash", "grp", own_lang.alias("l"), "stop").agg(F.first("evidence").alias("evidence"), F.first("start").alias("start"))
    single = materialize(single, "classes")
    shares = None
    for _ in range(_ROUNDS):
        held = single if shares is None else single.join(shares, ["grp", "l", "stop"])
        odds = _logit(F.least(F.greatest("start" if shares is None else "prior", F.lit(_LEAST_SHARE)), F.lit(_MOST_SHARE)))
        cut = 1 / (1 + F.exp(-(F.col("evidence") + odds)))
        found = held.groupBy("grp", "l", "stop").agg(((F.sum(cut) + _CLASS_PULL * usual) / (F.count("*") + _CLASS_PULL)).alias("prior"))
        shares = materialize(found, "shares")
    shares = shares.select("grp", "l", "stop", F.least(F.greatest("prior", F.lit(_LEAST_SHARE)), F.lit(_MOST_SHARE)).alias("prior"))
    return scored.withColumn("l", own_lang).join(shares, ["grp", "l", "stop"]).select("item", "lang", "grp", "evidence", "planted", "prior")


def _thresholds(scored: DataFrame) -> DataFrame:
    """``lang, threshold`` on the log-odds: of the bounds of ``_BINS`` bins the
    one with the largest expected harmonic mean of recall, as measured on the
    planted cuts, and precision.  The whole column counts for
    ``_LANGUAGE_PULL`` texts of each language."""
    odds = _logit(F.col("prior"))
    bin_ = lambda x: F.least(F.greatest(F.floor((x + odds) / _BIN), F.lit(-(_BINS // 2))), F.lit(_BINS // 2)).cast("int")
    rows = scored.select("lang", F.explode(F.array(
        F.struct(bin_(F.col("evidence")).alias("bin"), F.lit(1.0).alias("n"), F.lit(0.0).alias("cut")),
        F.struct(bin_(F.col("planted")).alias("bin"), F.lit(0.0).alias("n"), F.col("prior").alias("cut")),
    )).alias("x")).select("lang", "x.*")
    each = materialize(rows.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("cut").alias("cut")), "odds")
    every = each.groupBy("bin").agg(F.sum("n").alias("all_n"), F.sum("cut").alias("all_cut"))
    part = F.lit(_LANGUAGE_PULL) / F.lit(max(1.0, each.agg(F.sum("n")).first()[0] or 1.0))
    bins = F.explode(F.sequence(F.lit(-(_BINS // 2)), F.lit(_BINS // 2))).alias("bin")
    grid = each.select("lang").distinct().select("lang", bins).join(every, "bin").join(each, ["lang", "bin"], "left").na.fill(0.0)  # 677 languages x 49 bins at most
    both = grid.select("lang", "bin", (F.col("n") + part * F.col("all_n")).alias("n"), (F.col("cut") + part * F.col("all_cut")).alias("cut"))
    above = Window.partitionBy("lang").orderBy(F.desc("bin"))
    whole = Window.partitionBy("lang")
    flagged, found = F.sum("n").over(above), F.sum("cut").over(above)
    fit = both.select("lang", "bin", (2 * found / (F.sum("cut").over(whole) + flagged)).alias("fit"))
    # Of equal ones the bound next to even odds.
    return fit.groupBy("lang").agg((F.max_by("bin", F.struct(F.round("fit", 4), -F.abs("bin"))) * _BIN).cast("double").alias("threshold"))


def cut_scores(df: DataFrame, item_col: str, text_col: str, lang_col: str, group_col: str | None = None, topic_col: str | None = None) -> DataFrame:
    """``item, grp, log_odds`` of every text that isn't blank; above 0 it was
    cut (the log-odds of a cut less the threshold of its language)."""
    model, features = fit_endings(df, item_col, text_col, lang_col, group_col, topic_col)
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = features.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, planted = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(_BITS)) for c in (6, 7))
            odds = [pa.array(held.value.evidence(own, True)), pa.array(held.value.evidence(planted, False))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *odds], names=[*batch.schema.names[:6], "evidence", "planted"])

    scored = features.mapInArrow(run, f"item {kind}, lang string, grp string, hash bigint, chars bigint, bytes bigint, evidence double, planted double")
    scored = materialize(_with_priors(materialize(scored, "evidence"), model.usual), "priors")
    odds = F.col("evidence") + _logit(F.col("prior")) - F.col("threshold")
    return scored.join(_thresholds(scored), "lang").select("item", "grp", odds.alias("log_odds"))


def find_cut_texts(df: DataFrame, item_col: str, text_col: str, lang_col: str, group_col: str | None = None) -> DataFrame:
    """``item_col`` of every text that was cut off; ``group_col`` names the
    source, whose field limits and share of cuts are its own.

    Null, empty and blank texts weren't cut; a repeated row of a cut text is a
    row of its own; a null language is a language, a null group a group; an
    empty table gives no rows.
    """
    return cut_scores(df, item_col, text_col, lang_col, group_col).where(F.col("log_odds") > 0).select(F.col("item").alias(item_col))


def cut_shares(df: DataFrame, item_col: str, text_col: str, lang_col: str, group_col: str) -> DataFrame:
    """Per source its texts (null and blank ones left out), cut ones and their
    share; sources that are null and empty are one, ``null``."""
    scores = cut_scores(df, item_col, text_col, lang_col, group_col)
    cut = F.count_if(F.col("log_odds") > 0)
    return scores.groupBy(F.nullif("grp", F.lit("")).alias(group_col)).agg(F.count("*").alias("texts"), cut.alias("cut"), F.round(cut / F.count("*"), 6).alias("share"))
