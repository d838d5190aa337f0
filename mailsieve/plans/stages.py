"""The steps of the extraction as stages with a ``transform``, and the types of what they add.

Each stage adds columns to a DataFrame of mails; one after the other they do what ``extract`` does at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..crf.model import CrfModel, labeled_lines
from ..functions.normalize import normalized_lines, trimmed
from ..functions.text import is_blank
from ..operators.assemble import assembled
from ..operators.features import annotated, structure, with_features
from ..operators.lines import content, reconstruct, with_gaps
from ..schema import FEATURES, LABELED_LINE, LABELS


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_TEXT, _INT, _FLAG = T.StringType(), T.IntegerType(), T.BooleanType()
Label = StrEnum("Label", {x: x for x in LABELS})

#: Types of the columns that the stages add.
LabeledLine = LABELED_LINE
LineFeatures = _struct(**FEATURES)
ExtractedFeatures = _struct(features=T.ArrayType(LineFeatures))
NormalizedEmail = _struct(lines=T.ArrayType(_TEXT))
AssembledBody = _struct(body_text=_TEXT, body_lines=T.ArrayType(_INT), signature_index=_INT, inline_quote_count=_INT, success=_FLAG)
SequenceLabelingResult = _struct(labeled_lines=T.ArrayType(LABELED_LINE), confidence=T.DoubleType())
AnnotatedLine = _struct(text=_TEXT, original_index=_INT, blank_lines_before=_INT, blank_lines_after=_INT, quote_depth=_INT, is_forward_reply_header=_FLAG, is_delimiter=_FLAG)
StructuralAnalysis = _struct(marks=T.ArrayType(AnnotatedLine), has_quotes=_FLAG, has_forward_reply=_FLAG, first_quote_index=_INT, last_quote_index=_INT)


@dataclass
class Normalizer:
    """``lines`` of the text, normalised, without blank ones at the ends; an empty array if nothing is left."""

    input_col: str = "email_text"

    def transform(self, mails: DataFrame) -> DataFrame:
        text = F.col(self.input_col)
        usable = F.when(text.isNotNull() & ~is_blank(text), text)
        return mails.withColumn("__all", normalized_lines(usable)).withColumn("lines", trimmed(F.col("__all"))).drop("__all")


class StructuralAnalyzer:
    """``marks``, the content lines with quote depth, header and delimiter marks, and what the mail as a whole has."""

    def transform(self, normalized: DataFrame) -> DataFrame:
        marks = annotated(with_gaps(content(F.col("lines")), F.size("lines")), ("quote_depth", "is_forward_reply_header", "is_delimiter"))
        out = normalized.withColumn("marks", marks)
        return out.withColumns(structure(F.col("marks")))


class FeatureExtractor:
    """``features``, 37 for each content line."""

    def transform(self, normalized: DataFrame) -> DataFrame:
        return with_features(normalized)


@dataclass
class SequenceLabeler:
    """``labeled_lines`` and the ``confidence`` of a mail, from its features."""

    model: CrfModel = field(default_factory=CrfModel.load)

    def transform(self, featured: DataFrame) -> DataFrame:
        out = featured.withColumn("prediction", self.model.predict(F.col("features")))
        out = out.withColumn("labeled_lines", labeled_lines(F.col("marks")["text"], F.col("prediction")))
        return out.withColumn("confidence", F.col("prediction.probability"))


class BodyAssembler:
    """``assembled``, the body that the labelled lines make."""

    def transform(self, labeled: DataFrame) -> DataFrame:
        return labeled.withColumn("document", reconstruct(F.col("lines"), F.col("labeled_lines"))).withColumn("assembled", assembled(F.col("document")))
