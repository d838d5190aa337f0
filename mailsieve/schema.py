"""Names and types of what the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

LABELS = ("GREETING", "BODY", "CLOSING", "SIGNATURE", "QUOTE", "OTHER")
CONTENT_LABELS = ("GREETING", "BODY", "CLOSING")

RATIOS = ("kanji_ratio", "hiragana_ratio", "katakana_ratio", "ascii_ratio", "digit_ratio", "symbol_ratio")
FLAGS = (
    "is_greeting", "is_closing", "has_contact_info", "has_company_pattern", "has_position_pattern",
    "has_name_pattern", "is_visual_separator", "has_meta_discussion", "is_inside_quotation_marks",
)
CONTEXT = ("context_greeting_count", "context_closing_count", "context_contact_count", "context_quote_count", "context_separator_count")

#: The 37 features of a line and their types, in order.
FEATURES: dict[str, T.DataType] = (
    {n: T.DoubleType() for n in ("position_normalized", "position_reverse")}
    | {n: T.IntegerType() for n in ("lines_from_start", "lines_from_end")}
    | {n: T.DoubleType() for n in ("position_rel_first_quote", "position_rel_last_quote")}
    | {"line_length": T.IntegerType()}
    | {n: T.DoubleType() for n in RATIOS}
    | {n: T.IntegerType() for n in ("leading_whitespace", "trailing_whitespace", "blank_lines_before", "blank_lines_after", "quote_depth")}
    | {n: T.BooleanType() for n in ("is_forward_reply_header", "preceded_by_delimiter", "is_delimiter", *FLAGS)}
    | {n: T.IntegerType() for n in CONTEXT}
    | {n: T.BooleanType() for n in ("in_bracketed_section", "bracket_has_signature_patterns")}
)

#: A training example: one label per line, blank ones too.
_LABELLED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("quote_depth", T.IntegerType())]))
EXAMPLE = T.StructType(
    [
        T.StructField("email_text", T.StringType()),
        T.StructField("lines", _LABELLED),
        T.StructField("line_labels", _LABELLED),
        T.StructField(
            "metadata",
            T.StructType([T.StructField("template_type", T.StringType()), T.StructField("has_signature", T.BooleanType()), T.StructField("has_inline_quote", T.BooleanType()), T.StructField("is_adversarial", T.BooleanType())]),
        ),
    ]
)

LABELED_LINE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("label_probabilities", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
