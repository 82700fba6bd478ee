"""Quantities recorded in different units: which unit a record was written in, and its value in seconds.

Distinct spellings found in the texts are matched with known spellings through an inverted index of character n-grams and verified by a weighted edit
distance. The resulting alias dictionary is joined to the distinct texts, each of which then states at most one unit, and the texts are joined to all rows.

A unit next to a number tells of another time ("limit 200 s") and states nothing; neither do negated units ("not s"), English words that only look like a
unit ("second try", "min of the three") nor single letters without a cue such as "in", "unit:", a bracket or a slash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.materialize import broadcast_if_small, materialize

#: Seconds of each unit, and spellings that stand for it.
SECONDS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0}
SPELLINGS = {
    "ns": "ns nsec nsecs nano nanos nanosec nanosecs nanosecond nanoseconds nanosekunde nanosekunden nanoseconde nanosecondes nanosegundo nanosegundos",
    "us": "us µs usec usecs µsec micro micros microsec microsecs microsecond microseconds mikrosekunde mikrosekunden microseconde microsecondes microsegundo microsegundos",
    "ms": "ms msec msecs milli millis millisec millisecs millisecond milliseconds millisekunde millisekunden milliseconde millisecondes milisegundo milisegundos",
    "s": "s sec secs second seconds sek sekunde sekunden seconde secondes segundo segundos",
    "min": "min mins minute minutes minuten minuto minutos",
    "h": "h hr hrs hour hours std stunde stunden heure heures hora horas",
}
#: Spellings of fewer letters than this are only taken as they are.
FUZZY_LETTERS = 6
GRAM = 3
#: Price of an edit: at the start of a word, where nano, micro and milli differ; of a doubled letter or at the end, where words are inflected; elsewhere.
HEAD_COST, SOFT_COST, EDIT_COST = 2.0, 0.5, 1.0
#: Greatest distance, as a part of the known spelling's letters.
MAX_DISTANCE = 0.18


def spelling_distance(a: str, b: str) -> float:
    """Weighted edit distance of two spellings; an insertion, deletion or substitution costs by its place (see the constants)."""

    def cost(word: str, i: int) -> float:
        if i < 3:
            return SOFT_COST if i and word[i] == word[i - 1] else HEAD_COST
        return SOFT_COST if word[i] == word[i - 1] or i == len(word) - 1 else EDIT_COST

    row = [0.0]
    for j in range(len(b)):
        row.append(row[j] + cost(b, j))
    for i in range(len(a)):
        new = [row[0] + cost(a, i)]
        for j in range(len(b)):
            same = row[j] if a[i] == b[j] else row[j] + max(cost(a, i), cost(b, j))
            new.append(min(same, row[j + 1] + cost(a, i), new[j] + cost(b, j)))
        row = new
    return row[-1]


def known_spellings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, u) for u, words in SPELLINGS.items() for w in words.split()], "known string, unit string")


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (GRAM - 1), F.lit(1))), lambda i: F.substring(padded, i, GRAM)))


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """``spelling``, ``unit`` for those of the distinct lower-case ``spellings`` (one column ``spelling``) that stand for a unit.

    A known spelling stands for itself. Longer ones may also be close to a known one: candidates share at least a third of their n-grams with it (found
    through the inverted index), and the weighted edit distance must be at most ``MAX_DISTANCE`` of its length. The nearest wins, then the alphabet.
    """
    known = known_spellings(spellings.sparkSession)
    exact = spellings.join(F.broadcast(known), spellings.spelling == known.known).select("spelling", "unit")
    index = known.filter(F.length("known") >= FUZZY_LETTERS).select("known", "unit", F.size(_grams(F.col("known"))).alias("_n"), F.explode(_grams(F.col("known"))).alias("_gram"))
    open_ = spellings.join(F.broadcast(known), spellings.spelling == known.known, "left_anti").filter(F.length("spelling") >= FUZZY_LETTERS - 1)
    pairs = (
        open_.select("spelling", F.explode(_grams(F.col("spelling"))).alias("_gram"))
        .join(F.broadcast(index), "_gram")
        .groupBy("spelling", "known", "unit")
        .agg(F.count("*").alias("_shared"), F.first("_n").alias("_n"))
        .filter(F.col("_shared") * 3 >= F.col("_n"))
    )

    @F.pandas_udf("double")
    def distance(a, b):
        return a.combine(b, spelling_distance)

    near = pairs.withColumn("_d", distance("spelling", "known")).filter(F.col("_d") <= MAX_DISTANCE * F.length("known"))
    best = near.groupBy("spelling").agg(F.min(F.struct("_d", "known", "unit")).alias("_best")).select("spelling", F.col("_best.unit").alias("unit"))
    return exact.unionByName(best)


NUMBER = r"[-+]?\d[\d'_.,  ]*(?:[eE][-+]?\d+)?"
_LONG = {"s": "seconds", "h": "hours"}


def _words(text: Column) -> Column:
    """The words of a text that may state a unit, in order (see the module's text)."""
    t = F.regexp_replace(text, "μ", "µ")
    t = F.regexp_replace(t, r"(\p{Ll})(\p{Lu})", "$1 $2")
    t = F.lower(t)
    t = F.regexp_replace(t, r"(\p{L})-(?=\p{L})", "$1")
    t = F.regexp_replace(t, r"\bticks? of 1 (?=\p{L})", "unit: ")
    t = F.regexp_replace(t, rf"{NUMBER}\s?[\p{{L}}µ]+", " ")
    t = F.regexp_replace(t, r"\b(not|nicht|no|never)\s+(in\s+)?[\p{L}µ]+", " ")
    t = F.regexp_replace(t, r"(?<!\bin )(?<!\bunit )(?<!\bunit: )(?<!=)\b(second|minute|hour|min|sec|micro|milli|nano)\s+(?!second|clock|difference)(?=[a-z])", " ")
    for letter, word in _LONG.items():
        t = F.regexp_replace(t, rf"(^\s*|\bin |\bunit:? ?|[\[(/=:_;]\s*){letter}(?![\p{{L}}\p{{N}}'_])", f"$1{word}")
    return F.filter(F.split(t, r"[^\p{L}µ]+"), lambda w: F.length(w) > 1)


def stated_units(texts: DataFrame) -> DataFrame:
    """``text``, ``unit`` for those of the distinct ``texts`` (one column ``text``) that state a unit; the first statement counts."""
    words = materialize(texts.select("text", F.posexplode(_words(F.col("text"))).alias("_at", "spelling")), "unit-words")
    aliases = alias_dictionary(words.select("spelling").distinct())
    return words.join(aliases, "spelling").groupBy("text").agg(F.min(F.struct("_at", "unit")).alias("_first")).select("text", F.col("_first.unit").alias("unit"))


MAX_BROADCAST_TEXTS = 20_000


def with_stated_unit(df: DataFrame, text: str, stated: DataFrame, name: str) -> DataFrame:
    """``df`` with the unit stated by its column ``text``. The dictionary is broadcast if its size allows; else a sort-merge join, which AQE splits by skew."""
    right = stated.select(F.col("text").alias("_text"), F.col("unit").alias(name))
    return df.join(right, df[text] == right["_text"], "left").drop("_text")


class Cell:
    """How a time's cell is written: bare number, number and one spelling, or several units or a clock."""

    PLAIN = rf"^(?:~|ca\.?|approx\.?)?\s*({NUMBER}(?:[ ]\d{{3}})*(?:[.,]\d+)?)$"
    UNIT_LAST = r"^(?:~|ca\.?|approx\.?)?\s*([-+]?\d[\d'_., ]*(?:[eE][-+]?\d+)?)\s*([\p{L}µ]+)\.?$"
    UNIT_FIRST = r"^([\p{L}µ]+)\.?\s*:\s*([-+]?\d[\d'_., ]*(?:[eE][-+]?\d+)?)$"
    ISO = r"^PT(?:(\d+(?:[.,]\d+)?)H)?(?:(\d+(?:[.,]\d+)?)M)?(?:(\d+(?:[.,]\d+)?)S)?$"
    COLONS = r"^(?:(\d+):)?(\d+):(\d+(?:[.,]\d+)?)$"
    MARKS = "^(?:(\\d+)\\s*(?:h|hrs?|hours?|std\\.?)\\s*)?(?:(\\d+)\\s*(?:'|′|m|min|mins|minutes?|minuten)\\.?\\s*)?(?:(\\d+(?:[.,]\\d+)?)\\s*(?:\"|''|″|s|sec|secs|seconds?|sek)\\.?)?$"

    @staticmethod
    def clean(cell: Column) -> Column:
        cell = F.regexp_replace(cell, "μ", "µ")
        return F.trim(F.regexp_replace(cell, "[   \\s]+", " "))

    @staticmethod
    def number(text: Column) -> Column:
        """The number of a text without unit: quotes, underscores and spaces part thousands, a single comma without point is decimal."""
        t = F.regexp_replace(text, r"['_ ]", "")
        single = t.rlike(r"^[^,.]*,[^,.]*$")
        return F.when(single, F.regexp_replace(t, ",", ".")).otherwise(F.regexp_replace(t, ",", "")).try_cast("double")


def read_cells(df: DataFrame, cell: str) -> DataFrame:
    """``df`` with ``_kind`` (``bare``, ``unit``, ``clock`` or null), ``_spelling`` and ``_number`` (seconds, if ``clock``; null or NaN: no time)."""
    c = Cell.clean(F.col(cell))
    low = F.lower(c)
    part = lambda pattern, i, text: F.coalesce(Cell.number(F.regexp_extract(text, pattern, i)), F.lit(0.0))
    has = lambda pattern, i, text: (F.regexp_extract(text, pattern, i) != "").cast("int")
    total = lambda pattern, text: part(pattern, 1, text) * 3600 + part(pattern, 2, text) * 60 + part(pattern, 3, text)
    several = lambda pattern, text: sum((has(pattern, i, text) for i in (2, 3)), has(pattern, 1, text))
    upper = F.upper(c)
    iso_n, marks_n = several(Cell.ISO, upper), several(Cell.MARKS, low)
    one_iso = F.when(has(Cell.ISO, 1, upper) == 1, "h").when(has(Cell.ISO, 2, upper) == 1, "min").otherwise("s")
    iso_value = part(Cell.ISO, 1, upper) + part(Cell.ISO, 2, upper) + part(Cell.ISO, 3, upper)
    written = F.lower(F.regexp_extract(c, Cell.UNIT_LAST, 2))
    # a lone "m" or a lone prime is minutes, a lone double prime seconds
    written = F.when(written == "m", "min").otherwise(written)
    bare = c.rlike(Cell.PLAIN)
    kind = (
        F.when(c.isNull() | (c == ""), None)
        .when(bare, "bare")
        .when(low.rlike(Cell.COLONS) | (iso_n >= 2) | (marks_n >= 2), "clock")
        .when((iso_n == 1) | c.rlike(Cell.UNIT_LAST) | c.rlike(Cell.UNIT_FIRST), "unit")
    )
    spelling = F.when(iso_n == 1, one_iso).when(c.rlike(Cell.UNIT_LAST), written).when(c.rlike(Cell.UNIT_FIRST), F.lower(F.regexp_extract(c, Cell.UNIT_FIRST, 1)))
    number = (
        F.when(bare, Cell.number(F.regexp_extract(c, Cell.PLAIN, 1)))
        .when(low.rlike(Cell.COLONS), total(Cell.COLONS, low))
        .when(iso_n >= 2, total(Cell.ISO, upper))
        .when(marks_n >= 2, total(Cell.MARKS, low))
        .when(iso_n == 1, iso_value)
        .when(c.rlike(Cell.UNIT_LAST), Cell.number(F.regexp_extract(c, Cell.UNIT_LAST, 1)))
        .when(c.rlike(Cell.UNIT_FIRST), Cell.number(F.regexp_extract(c, Cell.UNIT_FIRST, 2)))
    )
    return df.withColumns({"_kind": kind, "_spelling": spelling, "_number": number})


def recorded_units(spark: SparkSession, results: DataFrame, scheduling: DataFrame, blen: DataFrame, sources: DataFrame) -> DataFrame:
    """Every record with a time: ``tbl``, ``record_id``, ``heading``, ``unit`` (as recorded, ``clock`` for several units), ``value``, ``seconds``.

    A cell's own spelling goes before the remark, that before a note after the setup's name or the first line of the record's file, that before the source's description, that before the
    heading. NaN, null and cells without a time give no row; cells with a spelling that means nothing give none either. Null and empty texts state nothing.
    Records imported twice have ids of their own and stand twice. Texts are read whole; of two units in one
    text the first counts. Empty tables give no rows. Other columns of the tables are ignored, whatever their names.
    """
    empty = F.lit(None).cast("string")
    setup_note = F.nullif(F.regexp_extract("setup", r"\s+(\S.*)$", 1), F.lit(""))  # a setup's name has no blanks; what follows one is a note
    cells = materialize(read_cells(scheduling.select("record_id", "runtime_cell", "remark", "source_id", setup_note.alias("_line")), "runtime_cell"), "cells")
    timed = cells.filter(F.col("_kind").isNotNull() & F.col("_number").isNotNull() & ~F.isnan("_number"))
    parts = [
        results.filter(F.col("rep1").isNotNull() & ~F.isnan("rep1")).select(F.lit("results").alias("tbl"), "record_id", F.lit("s").alias("heading"), F.lit("bare").alias("_kind"), empty.alias("_spelling"), F.col("rep1").alias("_number"), "remark", empty.alias("_line"), "source_id"),
        timed.select(F.lit("scheduling_results").alias("tbl"), "record_id", F.lit("s").alias("heading"), "_kind", "_spelling", "_number", "remark", "_line", "source_id"),
        blen.filter(F.col("time_ms").isNotNull()).select(F.lit("results_blen_primitive_chain").alias("tbl"), "record_id", F.lit("ms").alias("heading"), F.lit("bare").alias("_kind"), empty.alias("_spelling"), F.col("time_ms").cast("double").alias("_number"), "remark", F.col("header_line").alias("_line"), "source_id"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    texts = results.select(F.col("remark").alias("text"))
    for df, c in ((scheduling, "remark"), (cells, "_line"), (blen, "remark"), (blen, "header_line"), (sources, "description")):
        texts = texts.unionByName(df.select(F.col(c).alias("text")))
    stated = materialize(stated_units(texts.filter(F.trim("text") != "").distinct()), "stated-units")
    stated = broadcast_if_small(stated, MAX_BROADCAST_TEXTS)
    spellings = timed.select(F.col("_spelling").alias("spelling")).filter("spelling is not null").distinct()
    aliases = broadcast_if_small(materialize(alias_dictionary(spellings), "cell-units"), MAX_BROADCAST_TEXTS).select(F.col("spelling").alias("_alias"), F.col("unit").alias("_cell_unit"))
    described = with_stated_unit(sources, "description", stated, "_source_unit").select(F.col("source_id").alias("_source"), "_source_unit")
    described = broadcast_if_small(described.filter("_source_unit is not null"), MAX_BROADCAST_TEXTS)
    rows = with_stated_unit(with_stated_unit(rows, "remark", stated, "_remark_unit"), "_line", stated, "_line_unit")
    rows = rows.join(described, F.col("source_id") == F.col("_source"), "left").join(aliases, F.col("_spelling") == F.col("_alias"), "left")
    unit = F.when(F.col("_kind") == "clock", "clock").when(F.col("_kind") == "unit", F.col("_cell_unit")).otherwise(F.coalesce("_remark_unit", "_line_unit", "_source_unit", "heading"))
    rows = rows.withColumn("unit", unit).filter(F.col("unit").isNotNull())
    factor = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SECONDS.items() for x in pair)), F.col("unit")), F.lit(1.0))
    return rows.select("tbl", "record_id", "heading", "unit", F.col("_number").alias("value"), (F.col("_number") * factor).alias("seconds"))
