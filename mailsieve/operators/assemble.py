"""The body of a labelled mail.

Content lines are greeting, body and closing lines before the first signature
line.  The body goes from the line after the last quote before the first
content line (else from the start) to the last content line; quotes between
content lines are part of it, and so is all else between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip
from ..schema import CONTENT_LABELS


def assembled(lines: Column) -> Column:
    """From an array of ``text``, ``label`` and ``is_blank`` (all lines): ``body_text``, ``body_lines``, ``signature_index``,
    ``inline_quote_count`` and ``success``."""
    return let(lines, _assembled)


def _assembled(lines: Column) -> Column:
    at = lambda test: F.transform(lines, lambda x, i: F.when(test(x, i), i))
    signature = F.array_min(at(lambda x, i: (x["label"] == "SIGNATURE") & ~x["is_blank"]))
    inside = lambda end: at(lambda x, i: x["label"].isin(*CONTENT_LABELS) & ~x["is_blank"] & (i < end))

    def body(places: Column) -> Column:
        first, last, quotes = F.array_min(places["inside"]), F.array_max(places["inside"]), places["quotes"]
        start = F.coalesce(F.array_max(F.filter(quotes, lambda q: q < first)) + 1, F.lit(0))
        text = F.array_join(F.slice(lines, start + 1, last - start + 1)["text"], "\n")
        found = F.struct(
            text.alias("body_text"),
            F.sequence(start, last).alias("body_lines"),
            places["signature"].alias("signature_index"),
            F.size(F.filter(quotes, lambda q: (q > first) & (q < last))).alias("inline_quote_count"),
            (strip(text) != "").alias("success"),
        )
        none = F.struct(F.lit("").alias("body_text"), F.array().cast("array<int>").alias("body_lines"), places["signature"].alias("signature_index"), F.lit(0).alias("inline_quote_count"), F.lit(False).alias("success"))
        return F.when(first.isNotNull(), found).otherwise(none)

    quotes = at(lambda x, i: (x["label"] == "QUOTE") & ~x["is_blank"])
    places = lambda s: F.struct(inside(F.coalesce(s, F.size(lines))).alias("inside"), quotes.alias("quotes"), s.alias("signature"))
    return let(signature, lambda s: let(places(s), body))


def assembled_rows(lines: DataFrame, key: str = "mail_id") -> DataFrame:
    """The same for rows of lines (``key``, ``pos``, ``text``, ``label``, ``is_blank``): one row per mail."""
    w = Window.partitionBy(key)
    full = ~F.col("is_blank")
    out = lines.withColumn("signature_index", F.min(F.when((F.col("label") == "SIGNATURE") & full, F.col("pos"))).over(w))
    inside = F.col("label").isin(*CONTENT_LABELS) & full & (F.col("pos") < F.coalesce("signature_index", F.lit(2**31 - 1)))
    out = out.withColumns({"first": F.min(F.when(inside, F.col("pos"))).over(w), "last": F.max(F.when(inside, F.col("pos"))).over(w)})
    quote = (F.col("label") == "QUOTE") & full
    out = out.withColumn("start", F.coalesce(F.max(F.when(quote & (F.col("pos") < F.col("first")), F.col("pos"))).over(w) + 1, F.lit(0)))
    taken = F.col("pos").between(F.col("start"), F.col("last"))
    parts = F.sort_array(F.collect_list(F.when(taken, F.struct("pos", "text"))))
    return out.groupBy(key).agg(
        F.array_join(parts["text"], "\n").alias("body_text"),
        F.first("signature_index").alias("signature_index"),
        F.count(F.when(quote & taken, 1)).alias("inline_quote_count"),
    ).withColumn("success", strip(F.col("body_text")) != "")
