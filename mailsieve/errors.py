"""Errors of the one-mail interface; the DataFrame interface has them as a column."""

from __future__ import annotations


class ExtractionError(Exception):
    """Base of all errors of an extraction."""

    def __init__(self, message: str):
        super().__init__(message)
        self.message = message


class InvalidInputError(ExtractionError):
    """There is nothing to work on."""


class NoBodyDetectedError(ExtractionError):
    """No line of the mail belongs to a body."""


class LowConfidenceError(ExtractionError):
    """The labels are less certain than asked for."""

    def __init__(self, message: str, confidence: float, threshold: float):
        super().__init__(message)
        self.confidence, self.threshold = confidence, threshold

    def __str__(self) -> str:
        return f"{self.message} (confidence: {self.confidence:.2f}, threshold: {self.threshold:.2f})"


def error_of(error) -> ExtractionError | None:
    """The exception for an ``error`` struct of a result row."""
    if error is None:
        return None
    if error["type"] == "LowConfidenceError":
        return LowConfidenceError(error["message"], error["confidence"], error["threshold"])
    return {"InvalidInputError": InvalidInputError, "NoBodyDetectedError": NoBodyDetectedError}[error["type"]](error["message"])
