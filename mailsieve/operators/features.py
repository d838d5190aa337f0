"""The 37 features of each content line of a mail."""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.batches import Lines, line_marks
from ..functions.patterns import Stripped, line_flags
from ..functions.text import class_shares, part
from ..schema import FEATURES, FLAGS, RATIOS
from .flat import CONTEXT, gaps
from .flat import features as made_features

_SIGNED = ("has_contact_info", "has_company_pattern", "has_name_pattern")
_BRACKETS = ("in_bracketed_section", "bracket_has_signature_patterns")
#: The marks that other features are made of; a feature that is not here is a mark itself.
_MADE_OF = (
    {f: (mark,) for f, mark in CONTEXT.items()}
    | {f: ("is_delimiter", *_SIGNED) for f in _BRACKETS}
    | {f: ("quote_depth",) for f in ("position_rel_first_quote", "position_rel_last_quote")}
    | {f: ("is_delimiter",) for f in ("preceded_by_delimiter", "is_visual_separator")}
    | {f: () for f in ("position_normalized", "position_reverse", "lines_from_start", "lines_from_end", "leading_whitespace", "trailing_whitespace")}
)
_STRUCTURE = {"has_quotes": "quote_depth", "has_forward_reply": "is_forward_reply_header", "first_quote_index": "quote_depth", "last_quote_index": "quote_depth"}


def annotated(full: Column, marks: Collection[str] | None = None, stripped: bool = False) -> Column:
    """Content lines with their own marks; ``full`` has ``text``, ``original_index`` and the blank lines around.

    Nothing in a lambda is pruned later, so only the ``marks`` that are asked for are made (all by default).
    """

    def one(x: Column) -> Column:
        text = x["text"]
        found = line_flags(Stripped(text) if stripped else text) | {"line_length": F.length(text)}
        own = [x[c].alias(c) for c in ("text", "original_index", "blank_lines_before", "blank_lines_after")]
        some = [v.alias(k) for k, v in found.items() if marks is None or k in marks]
        ratios = [class_shares(text).alias("ratios")] if marks is None or not set(RATIOS).isdisjoint(marks) else []
        return F.struct(*own, *some, *ratios)

    return F.transform(full, one)


def structure(lines: Column, names: Collection[str] = tuple(_STRUCTURE)) -> dict[str, Column]:
    """What a mail has: quotes, headers, and the first and last quoted line."""
    quoted = lambda: F.transform(lines, lambda x, i: F.when(x["quote_depth"] > 0, i))
    found = {
        "has_quotes": lambda: F.coalesce(F.exists(lines, lambda x: x["quote_depth"] > 0), F.lit(False)),
        "has_forward_reply": lambda: F.coalesce(F.exists(lines, lambda x: x["is_forward_reply_header"]), F.lit(False)),
        "first_quote_index": lambda: F.array_min(quoted()),
        "last_quote_index": lambda: F.array_max(quoted()),
    }
    return {k: make() for k, make in found.items() if k in names}


def with_features(mails: DataFrame, lines: str = "lines", names: Collection[str] = tuple(FEATURES)) -> DataFrame:
    """Adds ``marks`` (the annotated content lines), the columns of ``structure`` and ``features`` (an array of 37 fields).

    All is made in one Arrow function, which tests each distinct line of a batch once.  With ``names`` only these
    features are made, and only the marks and columns that they need.
    """
    whole = set(names) == set(FEATURES)
    needed = {*FLAGS, "quote_depth", "is_forward_reply_header", "is_delimiter", "line_length", *RATIOS} - {"is_visual_separator"} if whole else {m for f in names for m in _MADE_OF.get(f, (f,))}
    made, ordered = made_of(needed), [f for f in FEATURES if f in names]
    structured = [k for k, m in _STRUCTURE.items() if m in needed]
    types = T.StructType(
        [
            T.StructField("marks", T.ArrayType(_mark_type(needed))),
            *(T.StructField(k, T.BooleanType() if k.startswith("has") else T.IntegerType()) for k in structured),
            T.StructField("features", T.ArrayType(T.StructType([T.StructField(f, FEATURES[f]) for f in ordered]))),
        ]
    )
    kind = to_arrow_type(types)

    def run(x: pa.Array, sizes: pa.Array) -> pa.Array:
        own = Lines.of(x)
        content, at = own.content()
        n_lines = own.sizes
        marks = {k: v[content.ids] for k, v in line_marks(own.texts, made).items()}
        ends = pa.array(content.offsets, pa.int32(), mask=np.append(x.is_null().to_numpy(zero_copy_only=False), False))

        def listed(columns: dict[str, pa.Array | np.ndarray], kind: pa.StructType) -> pa.Array:
            return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(columns[f.name]).cast(f.type) for f in kind], fields=list(kind)))

        before, after = gaps(content, at, n_lines)
        described = {"text": content.texts.take(pa.array(content.ids)), "original_index": at, "blank_lines_before": before, "blank_lines_after": after} | marks
        if not set(RATIOS).isdisjoint(needed):
            described["ratios"] = pa.StructArray.from_arrays([pa.array(marks[r]) for r in RATIOS], names=list(RATIOS))
        first = lambda mask: content.first(mask, -1)
        found = {
            "has_quotes": lambda: pa.array(first(marks["quote_depth"] > 0) >= 0),
            "has_forward_reply": lambda: pa.array(first(marks["is_forward_reply_header"]) >= 0),
            "first_quote_index": lambda: _place(first(marks["quote_depth"] > 0)),
            "last_quote_index": lambda: _place(content.last(marks["quote_depth"] > 0, -1)),
        }
        columns = [listed(described, kind.field("marks").type.value_type), *(found[k]() for k in structured), listed(made_features(content, marks, at, n_lines, ordered), kind.field("features").type.value_type)]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    run.__annotations__ = {"x": pa.Array, "sizes": pa.Array, "return": pa.Array}
    # the lines are named twice, so that an Arrow function that makes them stays a step of its own
    out = mails.withColumn("__found", F.arrow_udf(run, types).asNondeterministic()(F.col(lines), F.size(lines)))
    return out.withColumns({f.name: part(F.col("__found"), f.name) for f in types}).drop("__found")


def made_of(needed: Collection[str]) -> set[str]:
    """The marks to make for those that are needed: the shares of characters come together."""
    return {*needed} | ({*RATIOS} if not set(RATIOS).isdisjoint(needed) else set())


def _mark_type(needed: Collection[str]) -> T.StructType:
    flag, number = T.BooleanType(), T.IntegerType()
    own = {"text": T.StringType()} | {c: number for c in ("original_index", "blank_lines_before", "blank_lines_after")}
    order = ("quote_depth", "is_forward_reply_header", "is_delimiter", *(f for f in FLAGS if f != "is_visual_separator"), "line_length")
    own |= {c: number if c in ("quote_depth", "line_length") else flag for c in order if c in needed}
    if not set(RATIOS).isdisjoint(needed):
        own["ratios"] = T.StructType([T.StructField(r, T.DoubleType()) for r in RATIOS])
    return T.StructType([T.StructField(k, v) for k, v in own.items()])


def _place(places: np.ndarray) -> pa.Array:
    return pa.array(places, pa.int32(), mask=places < 0)


__all__ = ["FLAGS", "annotated", "structure", "with_features"]
