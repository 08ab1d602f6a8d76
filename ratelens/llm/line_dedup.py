"""Repeated passages of lines: windows of three consecutive lines, found globally.

A window is three consecutive lines that are not blank (blanks at both ends of a line do not count). Of every
window that occurs more than once in the corpus, the first occurrence, by document and line, stays. The
lines that later occurrences cover are removed; overlapping windows merge into one longer gap. Blank lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import fresh, let, replaced, text_key
from ratelens.session import materialize

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(text: Column, size: int) -> Column:
    """Array of (at, a, b): the number of the window's first line among those not blank, and its 128-bit hash."""
    trimmed = F.filter(F.transform(_lines(text), lambda line: F.trim(line)), lambda line: line != "")
    hashed = F.transform(trimmed, lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b")))

    def window(lines: Column, i: Column) -> Column:
        held = [F.get(lines, i + k) for k in range(size)]
        return F.struct(
            i.alias("at"), F.xxhash64(*[h["a"] for h in held]).alias("a"), F.xxhash64(*[h["b"] for h in held]).alias("b")
        )

    def all_of(lines: Column) -> Column:
        starts = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.size(lines) - size))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: window(lines, i))

    return let(hashed, all_of)


def _without(text: Column, covered: Column) -> Column:
    """The text without the covered lines, which are numbered among the lines that are not blank."""

    def kept(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        filled = F.filter(numbers, lambda i: F.trim(F.get(lines, i)) != "")
        gone = let(filled, lambda at: F.transform(covered, lambda c: F.get(at, c)))
        return F.array_join(F.transform(F.array_except(numbers, gone), lambda i: F.get(lines, i)), "\n")

    return let(_lines(text), kept)


def covered_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, mark, covered): for each text with removals the numbers, among its lines that are not blank, to remove.

    `doc` is the id, `mark` a hash of the text, as an id may repeat with another text. Rows alike in both
    are one document here and are treated alike. Null texts and texts of fewer lines have no window.
    """
    keyed = docs.select(F.col(id).alias("doc"), text_key(F.col(text))[0].alias("mark"), F.col(text).alias("text"))
    spread_out = keyed.where(F.instr("text", "\n") > 0).select("doc", "mark", F.explode(_windows(F.col("text"), window)).alias("w"))
    occurrences = spread_out.select("doc", "mark", "w.at", "w.a", "w.b")
    place = F.struct("doc", "mark", "at")
    grouped = occurrences.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # A written table: a common window's occurrences can then be split over tasks in the join below.
    repeated = materialize(grouped.where(~F.col("first").eqNullSafe(F.col("last"))).select("a", "b", "first"))
    later = occurrences.join(repeated, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc", "mark").agg(F.collect_set("at").alias("starts")).select(
        "doc", "mark",
        F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + (window - 1))))).alias("covered"),
    )


def remove_repeated_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, length: str | None = "n_chars"
) -> DataFrame:
    """All rows and columns; `text` without the covered lines, `length` (if there is such a column) counted anew,
    and `removed_lines` added.

    A text without removals stays as it is, to the character; a null text stays null with 0 removed lines. A
    document all of whose lines are covered keeps an empty text (or its blank lines). An empty table gives an
    empty one. Extra columns are passed on; one named `removed_lines` is replaced.
    """
    covered = materialize(covered_lines(docs, id, text, window))
    own_doc, own_mark, lines = fresh(docs, "doc", "mark", "covered", "removed_lines")[:3]
    gone = covered.select(F.col("doc").alias(own_doc), F.col("mark").alias(own_mark), F.col("covered").alias(lines))
    mark = text_key(F.col(text))[0]
    # Merged at every size: the removals grow with the corpus, so they are never broadcast.
    joined = docs.join(gone.hint("merge"), F.col(id).eqNullSafe(F.col(own_doc)) & (mark == F.col(own_mark)), "left")
    columns = {text: F.when(F.col(lines).isNull(), F.col(text)).otherwise(_without(F.col(text), F.col(lines)))}
    out = replaced(joined, **columns, removed_lines=F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("int"))
    if length and length in docs.columns:
        out = replaced(out, **{length: F.char_length(F.col(text)).cast(dict(docs.dtypes)[length])})
    names = [c for c in docs.columns if c.lower() != "removed_lines"]
    return out.select(*[F.col(f"`{c}`") for c in names], "removed_lines")
