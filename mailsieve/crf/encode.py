"""The 51 numeric attributes of a line, from its 37 features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_NUMBERS = {
    "pos_norm": "position_normalized", "pos_rev": "position_reverse", "lines_from_start": "lines_from_start", "lines_from_end": "lines_from_end",
    "pos_rel_first_quote": "position_rel_first_quote", "pos_rel_last_quote": "position_rel_last_quote", "line_length": "line_length",
    "kanji_ratio": "kanji_ratio", "hiragana_ratio": "hiragana_ratio", "katakana_ratio": "katakana_ratio", "ascii_ratio": "ascii_ratio", "digit_ratio": "digit_ratio", "symbol_ratio": "symbol_ratio",
    "leading_ws": "leading_whitespace", "trailing_ws": "trailing_whitespace", "blank_lines_before": "blank_lines_before", "blank_lines_after": "blank_lines_after", "quote_depth": "quote_depth",
    "is_forward_reply_header": "is_forward_reply_header", "preceded_by_delimiter": "preceded_by_delimiter", "is_delimiter": "is_delimiter",
    "is_greeting": "is_greeting", "is_closing": "is_closing", "has_contact_info": "has_contact_info", "has_company_pattern": "has_company_pattern", "has_position_pattern": "has_position_pattern",
    "has_name_pattern": "has_name_pattern", "is_visual_separator": "is_visual_separator", "has_meta_discussion": "has_meta_discussion", "is_inside_quotation_marks": "is_inside_quotation_marks",
    "ctx_greeting": "context_greeting_count", "ctx_closing": "context_closing_count", "ctx_contact": "context_contact_count", "ctx_quote": "context_quote_count", "ctx_separator": "context_separator_count",
}
_BUCKETS = ("start", "early", "middle", "late", "end")
ATTRIBUTES = (
    "BOS", "EOS", *_NUMBERS, "quote_depth_cat:quoted", "quote_depth_cat:unquoted", *(f"pos_bucket:{b}" for b in _BUCKETS), "char_type:ascii_heavy", "char_type:japanese_heavy", "char_type:mixed",
    "in_bracketed_section", "bracket_has_signature_patterns", "bracket_cat:bracketed", "bracket_cat:unbracketed",
)


def attributes(features: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All lines of a batch of mails as rows of 51 numbers, and where each mail's lines start (one more than mails)."""
    offsets = features.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    return encode({f.name: features.flatten().field(i).to_numpy(zero_copy_only=False).astype(float) for i, f in enumerate(features.type.value_type)}, offsets), offsets


def encode(f: dict[str, np.ndarray], offsets: np.ndarray) -> np.ndarray:
    n = int(offsets[-1])
    x = np.zeros((n, len(ATTRIBUTES)))
    at = {a: i for i, a in enumerate(ATTRIBUTES)}
    full = offsets[1:] > offsets[:-1]
    x[offsets[:-1][full], at["BOS"]] = 1
    x[offsets[1:][full] - 1, at["EOS"]] = 1
    for a, name in _NUMBERS.items():
        x[:, at[a]] = f[name]
    quoted = f["quote_depth"] > 0
    x[:, at["quote_depth_cat:quoted"]], x[:, at["quote_depth_cat:unquoted"]] = quoted, ~quoted
    bucket = np.searchsorted([0.1, 0.3, 0.7, 0.9], f["position_normalized"], side="right")
    for k, b in enumerate(_BUCKETS):
        x[:, at[f"pos_bucket:{b}"]] = bucket == k
    ascii_heavy = f["ascii_ratio"] > 0.8
    japanese = ~ascii_heavy & (f["kanji_ratio"] + f["hiragana_ratio"] > 0.7)
    x[:, at["char_type:ascii_heavy"]], x[:, at["char_type:japanese_heavy"]], x[:, at["char_type:mixed"]] = ascii_heavy, japanese, ~(ascii_heavy | japanese)
    inside = f["in_bracketed_section"] > 0
    x[:, at["in_bracketed_section"]], x[:, at["bracket_has_signature_patterns"]] = inside, f["bracket_has_signature_patterns"]
    x[:, at["bracket_cat:bracketed"]], x[:, at["bracket_cat:unbracketed"]] = inside, ~inside
    return x
