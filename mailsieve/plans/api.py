"""One mail at a time, on top of the DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Row, SparkSession

from ..crf.model import CrfModel
from ..errors import ExtractionError, NoBodyDetectedError, error_of
from .pipeline import extract


@dataclass(frozen=True)
class ExtractionResult:
    body: str | None
    confidence: float
    success: bool
    error: ExtractionError | None = None
    labeled_lines: tuple[Row, ...] = ()
    signature_detected: bool = False
    inline_quotes_included: int = 0


class MailBodyExtractor:
    """``extract`` raises, ``extract_safe`` gives None, and ``extract_with_metadata`` a result."""

    def __init__(self, model_path: str | None = None, confidence_threshold: float = 0.5, spark: SparkSession | None = None):
        self.confidence_threshold = confidence_threshold
        self._spark = spark
        self._model: CrfModel | None = None
        if model_path is not None:
            self.load_model(model_path)

    def load_model(self, path: str | None = None) -> None:
        self._model = CrfModel.load(path)

    @property
    def is_model_loaded(self) -> bool:
        return self._model is not None

    def extract_many(self, texts: list[str | None]) -> list[ExtractionResult]:
        if self._model is None:
            self.load_model()
        spark = self._spark or SparkSession.builder.getOrCreate()
        mails = spark.createDataFrame(list(enumerate(texts)), "n long, email_text string")
        rows = sorted(extract(mails, self._model, threshold=self.confidence_threshold).collect(), key=lambda r: r.n)
        return [ExtractionResult(r.body, r.confidence, r.success, error_of(r.error), tuple(r.labeled_lines or ()), r.signature_detected, r.inline_quotes_included) for r in rows]

    def extract_with_metadata(self, text: str | None) -> ExtractionResult:
        return self.extract_many([text])[0]

    def extract(self, text: str | None) -> str:
        result = self.extract_with_metadata(text)
        if result.error is not None:
            raise result.error
        if result.body is None:
            raise NoBodyDetectedError("No body content detected")
        return result.body

    def extract_safe(self, text: str | None) -> str | None:
        try:
            result = self.extract_with_metadata(text)
        except Exception:
            return None
        return result.body if result.success else None
