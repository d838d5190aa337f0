"""Features, labels and bodies of all mails of an Arrow batch at once, over ``batches.Lines``."""

from __future__ import annotations

from collections.abc import Callable, Collection
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.batches import Lines
from ..schema import CONTENT_LABELS, LABELS
from .brackets import repaired, section_flags, unified

#: What is counted in the lines around one, and the mark it is counted by.
CONTEXT = {
    "context_greeting_count": "is_greeting",
    "context_closing_count": "is_closing",
    "context_contact_count": "has_contact_info",
    "context_quote_count": "quote_depth",
    "context_separator_count": "is_delimiter",
}
CODE = {y: k for k, y in enumerate(LABELS)}
_NAMES = pa.array(LABELS)


def gaps(own: Lines, at: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many blank lines are before and after each content line."""
    before, after = np.empty_like(at), np.empty_like(at)
    before[1:], after[:-1] = at[:-1], at[1:]
    full = own.sizes > 0
    before[own.offsets[:-1][full]], after[own.offsets[1:][full] - 1] = -1, n_lines[full]
    return at - before - 1, after - at - 1


def around(own: Lines, mark: np.ndarray) -> np.ndarray:
    """How many of the two lines before and the two after each have a mark."""
    sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    here = np.arange(len(mark))
    start, end = np.repeat(own.offsets[:-1], own.sizes), np.repeat(own.offsets[1:], own.sizes)
    return sums[np.minimum(here + 3, end)] - sums[np.maximum(here - 2, start)] - mark


def per_mail(own: Lines, run: Callable[[int, int], np.ndarray], like: tuple[np.ndarray, ...], only: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Fills ``out`` for the mails in ``only``; mails that are alike in all of ``like`` are worked on once a batch."""
    seen: dict[tuple[bytes, ...], np.ndarray] = {}
    for k in np.flatnonzero(only):
        a, b = own.offsets[k], own.offsets[k + 1]
        key = tuple(x[a:b].tobytes() for x in like)
        if (found := seen.get(key)) is None:
            found = seen[key] = run(a, b)
        out[a:b] = found
    return out


def sections(own: Lines, separators: np.ndarray, signed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``section_flags`` of each mail."""
    several = np.bincount(own.mail, separators, len(own.sizes)) > 1
    # what is no separator matters by its marks only
    kind = np.where(separators, own.ids, -1).astype(np.int32)

    def run(a: int, b: int) -> np.ndarray:
        texts = [x or "" for x in own.texts.take(pa.array(kind[a:b], mask=kind[a:b] < 0)).to_pylist()]
        return np.array(section_flags(texts, separators[a:b].tolist(), signed[a:b].tolist())).T

    out = per_mail(own, run, (kind, signed), several, np.zeros((len(own.ids), 2), bool))
    return out[:, 0], out[:, 1]


def features(own: Lines, marks: dict[str, np.ndarray], at: np.ndarray, n_lines: np.ndarray, names: Collection[str]) -> dict[str, np.ndarray]:
    """The features of content lines by name, from their marks and their places ``at`` among all lines."""
    n, i = np.repeat(own.sizes, own.sizes), own.place
    before, after = gaps(own, at, n_lines)
    share: list[np.ndarray] = []

    def position() -> np.ndarray:
        if not share:
            share.append(np.where(n > 1, i / np.maximum(n - 1, 1), 0.0))
        return share[0]

    def quote(places: np.ndarray) -> np.ndarray:
        q = np.repeat(places, own.sizes)
        return np.where(q < 0, 0.0, (i - q) / np.maximum(n, 1))

    def preceded() -> np.ndarray:
        out = np.zeros(len(i), bool)
        out[1:] = marks["is_delimiter"][:-1]
        out[own.offsets[:-1][own.sizes > 0]] = False
        return out

    zero = np.zeros(len(i), np.int32)
    found = {
        "position_normalized": position,
        "position_reverse": lambda: 1.0 - position(),
        "lines_from_start": lambda: i,
        "lines_from_end": lambda: n - 1 - i,
        "position_rel_first_quote": lambda: quote(own.first(marks["quote_depth"] > 0, -1)),
        "position_rel_last_quote": lambda: quote(own.last(marks["quote_depth"] > 0, -1)),
        "leading_whitespace": lambda: zero,
        "trailing_whitespace": lambda: zero,
        "blank_lines_before": lambda: before,
        "blank_lines_after": lambda: after,
        "preceded_by_delimiter": preceded,
        "is_visual_separator": lambda: marks["is_delimiter"],
    }
    found |= {f: (lambda m=m: around(own, marks[m] > 0)) for f, m in CONTEXT.items()}
    out = {f: found[f]() if f in found else marks[f] for f in names if f not in ("in_bracketed_section", "bracket_has_signature_patterns")}
    if len(out) < len(names):
        out["in_bracketed_section"], out["bracket_has_signature_patterns"] = sections(own, marks["is_delimiter"], marks["has_contact_info"] | marks["has_company_pattern"] | marks["has_name_pattern"])
    return {f: out[f] for f in names}


def by_rule(marks: dict[str, np.ndarray]) -> np.ndarray:
    """Codes of labels that follow from the marks."""
    signature = marks["has_contact_info"] | marks["has_position_pattern"] | marks["has_name_pattern"]
    rules = [(marks["quote_depth"] > 0) | marks["is_forward_reply_header"], signature, marks["is_closing"] | marks["is_delimiter"], marks["is_greeting"]]
    return np.select(rules, [CODE[y] for y in ("QUOTE", "SIGNATURE", "CLOSING", "GREETING")], CODE["BODY"]).astype(np.int8)


def label_names(codes: np.ndarray) -> pa.Array:
    return _NAMES.take(pa.array(codes))


def carried(lines: Lines, at: np.ndarray, own: Lines) -> tuple[np.ndarray, np.ndarray]:
    """For each line the row of the content line whose label it has, -1 before the first one, and whether it is blank."""
    blank = np.ones(len(lines.ids), bool)
    blank[np.repeat(lines.offsets[:-1], own.sizes) + at] = False
    row = np.cumsum(~blank) - 1
    return np.where(row < np.repeat(own.offsets[:-1], lines.sizes), -1, row), blank


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as Spark does: by the decimal form, halves away from zero."""
    scaled = x * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    for k in np.flatnonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-6):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def settled(own: Lines, codes: np.ndarray, separators: np.ndarray, labels: list[str]) -> np.ndarray:
    """``unified(repaired(...))`` of the labels of each mail, as codes."""
    code = {y: k for k, y in enumerate(labels)} | {y: len(labels) + k for k, y in enumerate(y for y in ("BODY", "SIGNATURE") if y not in labels)}

    def run(a: int, b: int) -> np.ndarray:
        marks = separators[a:b].tolist()
        return np.array([code[y] for y in unified(repaired([labels[k] for k in codes[a:b]], marks), marks)], codes.dtype)

    return per_mail(own, run, (codes, separators), own.sizes > 0, codes.copy())


def bodies(lines: Lines, at: np.ndarray, own: Lines, labels: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The body of each mail (null if there is none), the place of its first signature line (-1) and how many quotes
    are in the body; ``own`` are the content lines, at the places ``at`` of all ``lines``."""
    codes = pc.fill_null(pc.index_in(labels, _NAMES), -1).to_numpy(zero_copy_only=False)
    whole = Lines(lines.offsets, np.full(len(lines.ids), -1), lines.texts)
    whole.ids[np.repeat(lines.offsets[:-1], own.sizes) + at] = codes
    c, place, size = whole.ids, whole.place, lines.sizes
    signature = whole.first(c == CODE["SIGNATURE"], -1)
    end = np.repeat(np.where(signature < 0, size, signature), size)
    inside = np.isin(c, [CODE[y] for y in CONTENT_LABELS]) & (place < end)
    first, last = whole.first(inside, -1), whole.last(inside, -1)
    quote = c == CODE["QUOTE"]
    begin = whole.last(quote & (place < np.repeat(first, size)), -1) + 1
    some = np.repeat(first >= 0, size)
    taken = some & (place >= np.repeat(begin, size)) & (place <= np.repeat(last, size))
    text = pc.binary_join(lines.where(taken).lists(), "\n")
    body = pc.if_else(pa.array(first >= 0), text, pa.scalar(None, pa.string()))
    between = quote & some & (place > np.repeat(first, size)) & (place <= np.repeat(last, size))
    return body, signature, np.bincount(whole.mail, between, len(size)).astype(np.int32)
