"""How good an extraction is: outcomes per mail, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines, strip
from ..schema import CONTENT_LABELS, LABELS


def squeezed(text: Column) -> Column:
    """Stripped lines that are not empty; a null is an empty text."""
    lines = F.transform(split_lines(F.coalesce(text, F.lit(""))), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def is_acceptable(expected: Column, found: Column) -> Column:
    """Equal, or one inside the other with lengths that differ by a tenth of the expected at most; both not empty."""
    a, b = strip(F.coalesce(expected, F.lit(""))), strip(F.coalesce(found, F.lit("")))
    near = 10 * F.abs(F.length(a) - F.length(b)) <= F.length(a)
    return (a != "") & (b != "") & ((a == b) | ((F.contains(a, b) | F.contains(b, a)) & near))


def outcomes(results: DataFrame, expected: str = "expected_body") -> DataFrame:
    """Adds to results (``body``, ``success``, ``error``) the flags of each mail."""
    body, want = F.coalesce("body", F.lit("")), F.coalesce(F.col(expected), F.lit(""))
    answered = F.col("success") & (strip(body) != "")
    match = answered & (squeezed(body) == squeezed(want))
    return results.withColumns(
        {
            "answered": answered,
            "exact_match": answered & (strip(body) == strip(want)),
            "content_match": match,
            "acceptable": answered & is_acceptable(want, body),
            "confident_wrong": answered & ~match,
            "failed_static": ~answered,
            "error_type": F.when(~answered, F.coalesce(F.col("error.type"), F.lit("EmptyBody"))),
        }
    )


def rates(flagged: DataFrame, *by: str) -> DataFrame:
    """Counts and shares of the outcomes, 0 if there is no mail."""
    names = ("exact_match", "content_match", "acceptable", "confident_wrong", "failed_static")
    counts = [F.coalesce(F.sum(F.col(n).cast("long")), F.lit(0)).alias(f"n_{n}") for n in names]
    out = (flagged.groupBy(*by) if by else flagged.groupBy()).agg(F.count("*").alias("n_total"), *counts)
    return out.withColumns({f"{n}_rate": F.coalesce(F.try_divide(F.col(f"n_{n}"), F.col("n_total")), F.lit(0.0)) for n in names})


def label_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label from ``predicted`` and ``truth`` (arrays); mails where these differ in
    length do not count."""
    pairs = rows.where(F.size("predicted") == F.size("truth")).select(F.explode_outer(F.arrays_zip(F.col("predicted").alias("p"), F.col("truth").alias("t"))).alias("x")).where("x is not null")
    # counted by pair first: all that follows is over a few rows
    counts = pairs.groupBy(F.col("x.p").alias("p"), F.col("x.t").alias("t")).agg(F.count("*").alias("n"))
    side = lambda label, name: F.struct(F.col(label).alias("label"), F.lit(name).alias("side"))
    sides = counts.select("n", F.explode(F.when(F.col("p") == F.col("t"), F.array(side("p", "tp"))).otherwise(F.array(side("p", "fp"), side("t", "fn")))).alias("s")).select("n", "s.*")
    out = sides.groupBy("label").agg(*(F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s) for s in ("tp", "fp", "fn")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confidence_stats(results: DataFrame, value: str = "confidence") -> DataFrame:
    """Mean, extremes, median and tenths of the successful mails: the values at places ``int(n * q)`` of the sorted ones.

    The places are found by counting equal values first, so that what is sorted on one machine are distinct values
    rounded to six digits, at most a million.
    """
    ok = results.where("success").select(F.col(value).alias("v"))
    steps = ok.groupBy(F.round("v", 6).alias("v")).agg(F.count("*").alias("c"))
    ends = steps.withColumn("to", F.sum("c").over(Window.orderBy("v")))
    total = ok.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    places = {"median": 0.5, "p10": 0.1, "p90": 0.9}
    n = total.first().n
    at = {name: (n // 2 if name == "median" else int(n * q)) for name, q in places.items()}
    found = ends.agg(*(F.min(F.when(F.col("to") > k, F.col("v"))).alias(name) for name, k in at.items())).first()
    return total.select("*", *(F.lit(found[name]).cast("double").alias(name) for name in places))


def counts_by(rows: DataFrame, column: str, name: str = "n", default: str = "unknown") -> DataFrame:
    """How many rows there are of each value, the most frequent first."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit(default)).alias(column)).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def label_distribution(labels: DataFrame, column: str = "label") -> DataFrame:
    """Counts and percentages of labels."""
    out = labels.groupBy(column).agg(F.count("*").alias("n"))
    # over a row for each label, so that the labels are made once
    return out.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(column)


def confident_wrong(results: DataFrame, expected: str = "expected_body", threshold: float = 0.5, limit: int | None = None) -> DataFrame:
    """Mails with a body and enough confidence whose text is not the expected one."""
    out = results.where(F.col("body").isNotNull() & (F.col("confidence") >= threshold) & (squeezed(F.col("body")) != squeezed(F.col(expected))))
    return out if limit is None else out.limit(limit)


def aligned(predicted: Column, truth: Column) -> Column:
    """Labels side by side by place: ``predicted``, ``truth`` ("?" where one is missing) and whether they differ."""
    n = F.greatest(F.size(predicted), F.size(truth))
    side = lambda x, i: F.coalesce(F.get(x, i), F.lit("?"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(side(predicted, i).alias("predicted"), side(truth, i).alias("truth"), (side(predicted, i) != side(truth, i)).alias("differs")))


def first_line_with(texts: Column, part: str) -> Column:
    """The place of the first line that holds a text, or null."""
    return F.array_min(F.transform(texts, lambda x, i: F.when(F.contains(x, F.lit(part)), i)))


__all__ = ["CONTENT_LABELS", "LABELS", "aligned", "confidence_stats", "confident_wrong", "counts_by", "first_line_with", "is_acceptable", "label_distribution", "label_metrics", "outcomes", "rates", "squeezed"]
