"""Extracts the body of plain-text Japanese business mail, as Spark DataFrame operations."""

__version__ = "0.1.0"


def __getattr__(name: str):
    """The public names, imported when they are first used."""
    from importlib import import_module

    places = {
        "BodyExtractor": "mailsieve.plans.pipeline",
        "MailBodyExtractor": "mailsieve.plans.api",
        "ExtractionResult": "mailsieve.plans.api",
        "CrfModel": "mailsieve.crf.model",
        "CrfEstimator": "mailsieve.crf.train",
        "ExtractionError": "mailsieve.errors",
        "InvalidInputError": "mailsieve.errors",
        "NoBodyDetectedError": "mailsieve.errors",
        "LowConfidenceError": "mailsieve.errors",
        "LABELS": "mailsieve.schema",
    }
    places |= {n: "mailsieve.plans.stages" for n in _STAGES}
    places |= {n: "mailsieve.functions.patterns" for n in _PREDICATES}
    own = _OTHER_NAMES.get(name, name)
    if own in places:
        return getattr(import_module(places[own]), own)
    raise AttributeError(name)


_STAGES = (
    "AnnotatedLine", "AssembledBody", "BodyAssembler", "ExtractedFeatures", "FeatureExtractor", "Label", "LabeledLine", "LineFeatures",
    "NormalizedEmail", "Normalizer", "SequenceLabeler", "SequenceLabelingResult", "StructuralAnalysis", "StructuralAnalyzer",
)
_PREDICATES = ("is_closing", "is_company", "is_contact_info", "is_greeting", "is_separator")
#: Names that users of such engines may know, and what they are called here.
_OTHER_NAMES = {
    "EmailBodyExtractor": "MailBodyExtractor", "CRFSequenceLabeler": "SequenceLabeler", "CRFTrainer": "CrfEstimator",
    "is_closing_line": "is_closing", "is_company_line": "is_company", "is_contact_info_line": "is_contact_info", "is_greeting_line": "is_greeting", "is_separator_line": "is_separator",
}
