"""The whole extraction, from a column of mail texts to one result per mail, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..crf.encode import encode
from ..crf.model import PREDICTION, CrfModel, labeled_lines
from ..functions.batches import in_parts, line_marks
from ..functions.normalize import normalized_batch, normalized_lines, trimmed
from ..functions.text import is_blank, part
from ..operators.assemble import assembled
from ..operators.features import with_features
from ..operators.flat import bodies, features
from ..operators.lines import reconstruct
from ..schema import FEATURES, FLAGS, RATIOS

ERROR = "struct<type:string,message:string,confidence:double,threshold:double>"
EMPTY, BLANK, NO_BODY, UNSURE = "Empty input", "Empty input after normalization", "No body content detected", "Confidence below threshold"


def error(kind: str, message: str, confidence: Column | None = None, threshold: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"), (none if confidence is None else confidence).alias("confidence"), (none if threshold is None else threshold).alias("threshold"))


def gate(text: Column, lines: Column, has_body: Column, confidence: Column, threshold: float) -> Column:
    """The error of a mail, or null: nothing in it, nothing left of it, no body, or a confidence under the threshold."""
    return _gate(text, F.size(lines) > 0, has_body, confidence, threshold)


def _gate(text: Column, some: Column, has_body: Column, confidence: Column, threshold: float) -> Column:
    limit = F.lit(float(threshold))
    return (
        F.when(text.isNull() | is_blank(text), error("InvalidInputError", EMPTY))
        .when(~some, error("InvalidInputError", BLANK))
        .when(~has_body, error("NoBodyDetectedError", NO_BODY))
        .when(confidence < limit, error("LowConfidenceError", UNSURE, confidence, limit))
        .otherwise(F.lit(None).cast(ERROR))
    )


def error_text(e: Column) -> Column:
    """An error as one line."""
    sure = F.format_string(" (confidence: %.2f, threshold: %.2f)", e["confidence"], e["threshold"])
    return F.when(e["type"] == "LowConfidenceError", F.concat(e["message"], sure)).otherwise(e["message"])


def prepared(mails: DataFrame, text_col: str = "email_text") -> DataFrame:
    """Adds ``lines``, ``marks``, the columns of the structure, and ``features``."""
    text = F.col(text_col)
    usable = F.when(text.isNotNull() & ~is_blank(text), text)
    out = mails.withColumn("__all", normalized_lines(usable)).withColumn("lines", trimmed(F.col("__all"))).drop("__all")
    return with_features(out)


#: What ``predicted`` finds in a mail; ``signature_index`` is -1 without a signature.
FOUND = f"struct<n_lines:int,content:array<string>,prediction:{PREDICTION},body:string,signature_index:int,inline_quote_count:int>"


def finder(model: CrfModel) -> Callable[[pa.Array], pa.Array]:
    """What the extraction finds in the mails of a batch (rows of ``FOUND``), as a function of their texts."""
    marked = {*FLAGS, "quote_depth", "is_forward_reply_header", "is_delimiter", "line_length", *RATIOS} - {"is_visual_separator"}
    kind = to_arrow_type(_parse_datatype_string(FOUND))

    def some(x: pa.Array) -> pa.Array:
        lines = normalized_batch(x)
        own, at = lines.content()
        marks = {k: v[own.ids] for k, v in line_marks(lines.texts, marked).items()}
        numbers = encode({f: np.asarray(v, float) for f, v in features(own, marks, at, lines.sizes, tuple(FEATURES)).items()}, own.offsets)
        prediction = model.prediction(numbers, own)
        body, signature, quotes = bodies(lines, at, own, prediction.field("labels").flatten())
        return pa.StructArray.from_arrays([pa.array(lines.sizes, pa.int32()), own.lists(), prediction.cast(kind.field("prediction").type), body, pa.array(signature, pa.int32()), pa.array(quotes, pa.int32())], fields=list(kind))

    return lambda x: in_parts(x, some, kind)


def predicted(text: Column, model: CrfModel) -> Column:
    """The same in a column."""
    find = finder(model)

    def run(x: pa.Array) -> pa.Array:
        return find(x)

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, FOUND).asNondeterministic()(text)


def extract(mails: DataFrame, model: CrfModel, text_col: str = "email_text", threshold: float = 0.5, keep_stages: bool = False, keep_prediction: bool = False) -> DataFrame:
    """``mails`` with ``body``, ``confidence``, ``success``, ``error``, ``labeled_lines``, ``signature_detected`` and
    ``inline_quotes_included``; with ``keep_prediction`` also the arrays that ``labeled_lines`` is made of, and with
    ``keep_stages`` all that led there."""
    if keep_stages:
        out = prepared(mails, text_col).withColumn("prediction", model.predict(F.col("features")))
        out = out.withColumn("labeled_lines", labeled_lines(F.col("marks")["text"], F.col("prediction")))
        out = out.withColumn("document", reconstruct(F.col("lines"), F.col("labeled_lines"))).withColumn("assembled", assembled(F.col("document")))
        some, has_body, body = F.size("lines") > 0, F.col("assembled.success"), F.col("assembled.body_text")
        signed, quotes = F.col("assembled.signature_index").isNotNull(), F.col("assembled.inline_quote_count")
    else:
        out = mails.withColumn("__found", predicted(F.col(text_col), model)).withColumn("prediction", part(F.col("__found"), "prediction"))
        out = out.withColumn("labeled_lines", labeled_lines(F.col("__found.content"), F.col("prediction")))
        some, has_body, body = F.col("__found.n_lines") > 0, F.col("__found.body").isNotNull(), F.col("__found.body")
        signed, quotes = F.col("__found.signature_index") >= 0, F.col("__found.inline_quote_count")
    sure = F.when(some, F.col("prediction.probability")).otherwise(F.lit(0.0))
    out = out.withColumn("confidence", sure).withColumn("error", _gate(F.col(text_col), some, has_body, F.col("confidence"), threshold))
    found = {"body": F.when(some & has_body, body), "success": F.col("error").isNull(), "signature_detected": signed, "inline_quotes_included": quotes}
    out = out.withColumns(found)
    result = ("body", "confidence", "success", "error", "labeled_lines", "signature_detected", "inline_quotes_included")
    stages = ("lines", "marks", "features", "has_quotes", "has_forward_reply", "first_quote_index", "last_quote_index", "prediction", "document", "assembled") if keep_stages else ("prediction",) if keep_prediction else ()
    own = [c for c in mails.columns if c not in (*result, *stages)]
    return out.select(*own, *stages, *result)


class BodyExtractor(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The extraction as a stage of a pipeline."""

    inputCol = Param(Params._dummy(), "inputCol", "column of mail texts", TypeConverters.toString)
    modelPath = Param(Params._dummy(), "modelPath", "file of the model; empty: the bundled one", TypeConverters.toString)
    confidenceThreshold = Param(Params._dummy(), "confidenceThreshold", "least probability of the labels", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "email_text", modelPath: str = "", confidenceThreshold: float = 0.5):
        super().__init__()
        self._setDefault(inputCol="email_text", modelPath="", confidenceThreshold=0.5)
        self._set(**self._input_kwargs)
        self._model: CrfModel | None = None

    @property
    def model(self) -> CrfModel:
        if self._model is None:
            self._model = CrfModel.load(self.getOrDefault(self.modelPath) or None)
        return self._model

    def setModel(self, model: CrfModel) -> BodyExtractor:
        self._model = model
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return extract(dataset, self.model, self.getOrDefault(self.inputCol), self.getOrDefault(self.confidenceThreshold))
