"""What an evaluation found, in tables and as text, and what one mail looks like inside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..crf.model import CrfModel
from ..operators.evaluate import confidence_stats, counts_by, label_metrics, rates
from ..operators.lines import exploded
from ..schema import LABELS
from .pipeline import error_text, extract, prepared


def by_group(flagged: DataFrame, group: str) -> DataFrame:
    """Failures of each kind by a group, such as ``metadata.template_type``; groups without any are left out."""
    own = flagged.withColumn("group", F.coalesce(F.col(group), F.lit("unknown")))
    out = own.groupBy("group").agg(*(F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in ("failed_static", "confident_wrong")))
    out = out.withColumn("n_failures", F.col("n_failed_static") + F.col("n_confident_wrong"))
    return out.where("n_failures > 0").orderBy(F.desc("n_failures"), "group")


def metrics(evaluated: DataFrame, group: str = "metadata.template_type") -> dict[str, DataFrame]:
    """The tables of a report over evaluated mails: rates, confidences, errors, labels and groups."""
    return {
        "rates": rates(evaluated),
        "confidence": confidence_stats(evaluated),
        "errors": counts_by(evaluated.where("failed_static"), "error_type"),
        "labels": label_metrics(evaluated).where(F.col("label").isin(*LABELS)).orderBy("label"),
        "groups": by_group(evaluated, group),
    }


def metrics_text(evaluated: DataFrame, group: str = "metadata.template_type", limit: int = 100) -> str:
    """The same as text; of errors and groups the most frequent ``limit``."""
    out = []
    for name, table in metrics(evaluated, group).items():
        out += [name.upper(), "-" * 60]
        out += ["  ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in row.asDict().items()) for row in table.limit(limit).collect()]
        out.append("")
    return "\n".join(out)


def first_failures(evaluated: DataFrame, order: str, limit: int = 20) -> DataFrame:
    """The first failures in the order of a column, with what was expected, found, and why."""
    own = evaluated.where(F.col("failed_static") | F.col("confident_wrong"))
    return own.orderBy(order).limit(limit).select(order, "confidence", error_text(F.col("error")).alias("error"), "expected_body", "body")


def rejections(examples: DataFrame) -> DataFrame:
    """How many training examples can't be used, by the reason: a label that is not known, or lines that don't match."""
    known = F.forall("lines_gold", lambda x: x["label"].isin(*LABELS))
    out = prepared(examples.withColumnRenamed("lines", "lines_gold"))
    reason = F.when(F.col("lines_gold").isNull() | (F.size("lines_gold") == 0), "no lines").when(~known, "unknown label").when(F.size("lines") != F.size("lines_gold"), "line count")
    return counts_by(out.withColumn("reason", F.coalesce(reason, F.lit("usable"))), "reason")


def inspected(mails: DataFrame, model: CrfModel, *keep: str, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Tables of what the extraction saw: a row per content line with its marks, with its features, and with the
    probabilities of all labels; and the result per mail."""
    out = extract(mails, model, threshold=threshold, keep_stages=True)
    line = lambda array, name: exploded(out, array, *keep, names=("idx", name)).select(*keep, "idx", f"{name}.*")
    labeled = exploded(out, "labeled_lines", *keep, names=("idx", "l"))
    return {
        "lines": line("marks", "m").drop("ratios"),
        "features": line("features", "f"),
        "marginals": labeled.select(*keep, "idx", "l.text", "l.label", "l.confidence", *(F.col("l.label_probabilities")[y].alias(f"p_{y.lower()}") for y in LABELS)),
        "result": out.select(*keep, "success", "confidence", error_text(F.col("error")).alias("error"), "body", "signature_detected", "inline_quotes_included"),
    }
