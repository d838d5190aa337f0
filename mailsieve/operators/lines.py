"""Lines of mails: the blank-line filter and its inverse, in rows of mails and in rows of lines.

Rows of mails hold their lines in an array: no shuffle, and good for streams.
Rows of lines are made from them by ``explode`` where lines of many mails are
counted or compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, let


def content(lines: Column) -> Column:
    """The lines that are not blank: ``text``, ``original_index``, ``blank_lines_before`` and ``blank_lines_after``."""
    full = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("text"), i.alias("original_index"))), lambda x: ~is_blank(x["text"]))
    return F.transform(full, lambda x, i: F.struct(x["text"].alias("text"), x["original_index"].alias("original_index")))


def with_gaps(full: Column, n_lines: Column) -> Column:
    """Adds to each content line how many blank ones are before and after it."""

    def all_of(full: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(full, i - 1)["original_index"], F.lit(-1))
            after = F.coalesce(F.get(full, i + 1)["original_index"], n_lines)
            at = x["original_index"]
            return F.struct(x["text"].alias("text"), at.alias("original_index"), (at - before - 1).alias("blank_lines_before"), (after - at - 1).alias("blank_lines_after"))

        return F.transform(full, one)

    return let(full, all_of)


def blank_map(lines: Column) -> Column:
    """What restores the blank lines: the places of the others and of the blank ones, and how many lines there are."""
    places = F.transform(lines, lambda x, i: F.struct(i.alias("i"), is_blank(x).alias("b")))
    where = lambda blank: F.transform(F.filter(places, lambda p: p["b"] == blank), lambda p: p["i"])
    return F.struct(where(F.lit(False)).alias("content_to_original"), where(F.lit(True)).alias("blank_positions"), F.size(lines).alias("original_line_count"))


def explode_lines(mails: DataFrame, lines: str = "lines", *keep: str) -> DataFrame:
    """One row per line: the kept columns, ``pos`` and ``text``."""
    return exploded(mails, lines, *keep, names=("pos", "text"))


def exploded(rows: DataFrame, array: str | Column, *keep: str | Column, names: tuple[str, str] = ("idx", "x")) -> DataFrame:
    """The kept columns, the place and the value of each element.

    A plain explode would make Spark test first whether the array is empty, and with that make the array twice, the
    second time wherever the test can be pushed to.
    """
    return rows.select(*keep, F.posexplode_outer(array).alias(*names)).where(F.col(names[0]).isNotNull())


def _places(lines: Column) -> Column:
    """The place of each line among the content lines; a blank one has that of the line before, -1 if there is none."""
    starts = F.concat(F.array(F.lit(0)), F.filter(F.transform(lines, lambda x, i: F.when(~is_blank(x), i)), lambda i: i.isNotNull()))
    run = lambda s: lambda x, k: F.array_repeat(k - 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - x)
    return let(starts, lambda s: F.flatten(F.transform(s, run(s))))


def reconstruct(lines: Column, labeled: Column) -> Column:
    """All lines of a mail with the labels of the content lines (in their order): a blank line takes the label
    before it, and has no confidence and no probabilities."""
    def all_of(known: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            at, blank = F.get(known["places"], i), is_blank(x)
            found = lambda name: F.when(at >= 0, F.get(known["labeled"], at)[name])
            return F.struct(
                x.alias("text"),
                i.alias("original_index"),
                blank.alias("is_blank"),
                found("label").alias("label"),
                F.when(~blank, found("confidence")).alias("confidence"),
                F.when(~blank, found("label_probabilities")).alias("label_probabilities"),
            )

        return F.transform(known["lines"], one)

    whole = F.struct(lines.alias("lines"), labeled.alias("labeled"))
    return let(whole, lambda k: let(F.struct(k["lines"].alias("lines"), k["labeled"].alias("labeled"), _places(k["lines"]).alias("places")), all_of))


def reconstruct_rows(lines: DataFrame, labeled: DataFrame, key: str = "mail_id") -> DataFrame:
    """The same for rows of lines (``key``, ``pos``, ``text``) and of labels (``key``, ``pos``, ``label``, ``confidence``)."""
    return carried_rows(lines.join(labeled.select(key, "pos", "label", "confidence"), [key, "pos"], "left"), key)


def carried_rows(lines: DataFrame, key: str = "mail_id") -> DataFrame:
    """The same where the rows of the content lines have their labels already."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("is_blank", is_blank(F.col("text")))
    return out.withColumn("label", F.last(F.when(~F.col("is_blank"), F.col("label")), ignorenulls=True).over(w)).withColumn("confidence", F.when(~F.col("is_blank"), F.col("confidence")))
