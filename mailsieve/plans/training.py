"""From labelled mails to a model, and from a model to its figures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..crf.model import CrfModel
from ..crf.train import CrfEstimator
from ..functions.batches import Lines, filled
from ..functions.normalize import normalized_texts
from ..functions.text import is_blank
from ..operators.evaluate import label_distribution, outcomes
from ..operators.flat import bodies
from ..schema import LABELS
from .pipeline import extract, prepared


def usable(examples: DataFrame) -> DataFrame:
    """Examples with known labels only and one label for each normalised line, with ``features`` and the ``labels`` of
    the content lines; labels of blank lines are dropped."""
    known = F.forall("lines_gold", lambda x: x["label"].isin(*LABELS))
    out = prepared(examples.withColumnRenamed("lines", "lines_gold").where(known))
    out = out.where(F.size("lines") == F.size("lines_gold"))
    full = F.filter(F.arrays_zip("lines", F.col("lines_gold")["label"].alias("label")), lambda x: ~is_blank(x["lines"]))
    return out.withColumn("labels", F.transform(full, lambda x: x["label"]))


def train(examples: DataFrame, estimator: CrfEstimator | None = None) -> tuple[CrfModel, DataFrame]:
    """The model and the distribution of the labels it learned from."""
    rows = usable(examples).select("features", "labels")
    if rows.isEmpty():
        raise ValueError("no example can be used")
    return (estimator or CrfEstimator()).fit(rows), label_distribution(rows.select(F.explode("labels").alias("label")))


def with_expected_body(examples: DataFrame, gold: str = "lines_gold") -> DataFrame:
    """Adds ``expected_body``, the body that gold lines (``text``, ``label``) stand for: each line is normalised by
    itself, blank lines at the ends go, and blank lines take the label before them."""

    def run(texts: pa.Array, labels: pa.Array) -> pa.Array:
        own = Lines.of(texts)
        lines = Lines(own.offsets, own.ids, normalized_texts(own.texts))
        content, at = lines.content()
        full = filled(lines.texts)[lines.ids] if len(lines.ids) else np.zeros(0, bool)
        # a body starts after a quote or with the first line that is not blank
        start = np.repeat(lines.first(full, 0), lines.sizes)
        kept = lines.place >= start
        at = at - start[full]
        body, _, _ = bodies(lines.where(kept), at, content, labels.flatten().cast(pa.string()).filter(pa.array(full)))
        return pc.fill_null(body, "")

    run.__annotations__ = {"texts": pa.Array, "labels": pa.Array, "return": pa.Array}
    texts = F.transform(gold, lambda x: F.coalesce(x["text"], F.lit("")))
    return examples.withColumn("expected_body", F.arrow_udf(run, "string").asNondeterministic()(texts, F.col(gold)["label"]))


def evaluate(examples: DataFrame, model: CrfModel, threshold: float = 0.5) -> DataFrame:
    """Examples with the extraction, the expected body and the flags of the outcome."""
    gold = examples.withColumnRenamed("lines", "lines_gold")
    out = with_expected_body(extract(gold, model, threshold=threshold))
    out = outcomes(out).withColumn("predicted", F.col("labeled_lines")["label"])
    return out.withColumn("truth", F.transform("lines_gold", lambda x: x["label"]))
