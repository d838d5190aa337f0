"""Lines of many mails at once, for Arrow functions: each distinct line of a batch is looked at once.

The patterns are those of ``patterns``, here run by Arrow's own engine, whose time is linear in the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import patterns as P
from .text import HIRAGANA, KANJI, KATAKANA, OTHER_DIGITS, WS_CHARS

_HIDDEN, _SPOKEN = 1, 2
_KINDS = {_HIDDEN: P._HIDDEN, _SPOKEN: P._SPOKEN, 4: KANJI, 8: HIRAGANA, 16: KATAKANA, 32: "A-Za-z", 64: "0-9" + OTHER_DIGITS}
_CLASSES = {"kanji_ratio": 4, "hiragana_ratio": 8, "katakana_ratio": 16, "ascii_ratio": 32, "digit_ratio": 64}


def matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def trimmed_texts(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(texts, characters=WS_CHARS)


def filled(texts: pa.Array) -> np.ndarray:
    """Which texts have more than white space."""
    return pc.not_equal(trimmed_texts(texts), "").to_numpy(zero_copy_only=False)


class CodePoints:
    """The code points of texts (no nulls) in one array, and how many of some kind each text has."""

    def __init__(self, texts: pa.Array):
        _, ends, raw = texts.buffers()
        at = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        inside = memoryview(raw)[at[0] : at[-1]] if raw is not None else b""
        self.points = np.frombuffer(str(inside, "utf-8").encode("utf-32-le"), np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
        self.lengths = np.diff(self.starts)

    def count(self, mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def of(self, k: int) -> np.ndarray:
        return self.points[self.starts[k] : self.starts[k + 1]]


class PointTable:
    """A property of code points, found out for each when it is first met."""

    def __init__(self, make: Callable[[list[str]], np.ndarray]):
        self.make, self.known, self.value = make, np.zeros(0x110000, bool), np.zeros(0x110000, np.uint8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        new = ~self.known[points]
        if new.any():
            fresh = np.unique(points[new])
            self.value[fresh] = self.make([chr(c) for c in fresh])
            self.known[fresh] = True
        return self.value[points]


def _kinds_of(chars: list[str]) -> np.ndarray:
    found = pa.array(chars, pa.string())
    return sum(np.where(matches(found, f"[{inside}]"), bit, 0) for bit, inside in _KINDS.items()).astype(np.uint8)


_kinds = PointTable(_kinds_of)


@dataclass
class Lines:
    """Lines of mails: where those of each mail start (one more than mails), the place of each in the distinct ``texts``."""

    offsets: np.ndarray
    ids: np.ndarray
    texts: pa.Array

    @classmethod
    def of(cls, lists: pa.Array) -> Lines:
        """From arrays of lines; a null array has none, and a null line is empty."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(lists.flatten(), "").cast(pa.string()).dictionary_encode()
        return cls(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), flat.indices.to_numpy(zero_copy_only=False), flat.dictionary)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def mail(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.sizes)

    @property
    def place(self) -> np.ndarray:
        return np.arange(len(self.ids)) - np.repeat(self.offsets[:-1], self.sizes)

    def where(self, keep: np.ndarray) -> Lines:
        sums = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
        return Lines(sums[self.offsets], self.ids[keep], self.texts)

    def content(self) -> tuple[Lines, np.ndarray]:
        """The lines that are not blank, and the place that each has among all."""
        keep = filled(self.texts)[self.ids] if len(self.ids) else np.zeros(0, bool)
        return self.where(keep), self.place[keep]

    def first(self, mask: np.ndarray, none: int) -> np.ndarray:
        """For each mail the place of its first line with a mark."""
        return self._reduced(np.minimum, mask, none)

    def last(self, mask: np.ndarray, none: int) -> np.ndarray:
        return self._reduced(np.maximum, mask, none)

    def _reduced(self, by: np.ufunc, mask: np.ndarray, none: int) -> np.ndarray:
        out = np.full(len(self.offsets) - 1, none, np.int64)
        full = self.sizes > 0
        if full.any():
            # an identity that any place replaces
            far = np.iinfo(np.int64).max if by is np.minimum else -1
            found = by.reduceat(np.where(mask, self.place, far), self.offsets[:-1][full])
            out[full] = np.where(found == far, none, found)
        return out

    def lists(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), self.texts.take(pa.array(self.ids)))


def split(text: pa.Array) -> Lines:
    return Lines.of(pc.split_pattern(text, "\n"))


def parts(text: pa.Array, most: int = 32_000_000) -> Iterator[tuple[int, int]]:
    """Runs of mails whose lines can be held and described at once."""
    weight = pc.add(pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), pc.multiply(pc.fill_null(pc.count_substring(text, "\n"), 0).cast(pa.int64()), 100))
    total = np.cumsum(weight.to_numpy(zero_copy_only=False))
    start = 0
    while start < len(text):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield start, end
        start = end


def in_parts(text: pa.Array, run: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``run`` over runs of mails, one after the other."""
    out = [run(text[a:b]) for a, b in parts(text)]
    return out[0] if len(out) == 1 else pa.concat_arrays(out) if out else pa.array([], kind)


def _quote_depth(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), np.int32)
    at = np.flatnonzero(matches(texts, "^[>|]"))
    for k, x in zip(at, texts.take(pa.array(at)).to_pylist(), strict=True):
        marks = x[: len(x) - len(x.lstrip(">|" + WS_CHARS))]
        out[k] = marks.count(">") + marks.count("|")
    return out


def _is_separator(own: CodePoints) -> np.ndarray:
    kinds = _kinds(own.points)
    sign = (kinds & (_HIDDEN | _SPOKEN)) == 0
    visible, signs = own.count((kinds & _HIDDEN) == 0), own.count(sign)
    out = (visible >= 2) & (signs == visible)
    for k in np.flatnonzero(~out & (signs >= 3) & (2 * signs >= visible)):
        most = max(Counter(own.of(k)[sign[own.starts[k] : own.starts[k + 1]]].tolist()).values())
        out[k] = most >= 3 and 2 * most >= visible[k]
    return out


def _is_name(stripped: pa.Array) -> np.ndarray:
    short = pc.less_equal(pc.utf8_length(stripped), 15).to_numpy(zero_copy_only=False)
    return matches(stripped, P.whole(P.NAME_SHAPES)) | short & ~matches(stripped, P._NOT_IN_NAMES) & matches(stripped, P.name_pattern())


def _contains_name(texts: pa.Array) -> np.ndarray:
    known = P.names()
    return matches(texts, P._any_of((*known["last"], *known["katakana"]))) | matches(pc.utf8_lower(texts), P._any_of(tuple(x.lower() for x in known["romaji"])))


def line_marks(texts: pa.Array, names: Collection[str] | None = None) -> dict[str, np.ndarray]:
    """What ``patterns.line_flags`` says of each text; also its ``line_length`` and, where asked for, the shares of
    classes of characters and whether it ``has_name``."""
    s = trimmed_texts(texts)
    full = pc.not_equal(s, "").to_numpy(zero_copy_only=False)
    points: list[CodePoints] = []

    def own() -> CodePoints:
        if not points:
            points.append(CodePoints(texts))
        return points[0]

    def share(bit: int) -> np.ndarray:
        return own().count((_kinds(own().points) & bit) > 0) / np.maximum(own().lengths, 1)

    def other() -> np.ndarray:
        return (own().lengths - own().count((_kinds(own().points) & sum(_CLASSES.values())) > 0)) / np.maximum(own().lengths, 1)

    makers = {
        "quote_depth": lambda: _quote_depth(texts),
        "is_forward_reply_header": lambda: matches(s, P.whole(P.HEADERS)),
        "is_delimiter": lambda: _is_separator(own()),
        "is_greeting": lambda: matches(s, P.whole(P.GREETINGS)),
        "is_closing": lambda: matches(s, P.whole(P.CLOSINGS)),
        "has_contact_info": lambda: full & matches(texts, P.anywhere(P.CONTACTS)),
        "has_company_pattern": lambda: full & matches(texts, P.anywhere(P.COMPANIES)),
        "has_position_pattern": lambda: full & matches(texts, P.anywhere(P.POSITIONS)),
        "has_name_pattern": lambda: _is_name(s),
        "has_meta_discussion": lambda: matches(texts, P.anywhere(P.META)),
        "is_inside_quotation_marks": lambda: matches(s, P.anywhere(P.QUOTED)) | pc.equal(s, '"').to_numpy(zero_copy_only=False),
        "line_length": lambda: own().lengths.astype(np.int32),
    }
    more = {k: (lambda bit=bit: share(bit)) for k, bit in _CLASSES.items()} | {"symbol_ratio": other, "has_name": lambda: _contains_name(texts)}
    return {k: make() for k, make in (makers | more).items() if (k in makers if names is None else k in names)}


__all__ = ["CodePoints", "Lines", "PointTable", "filled", "in_parts", "line_marks", "matches", "parts", "split", "trimmed_texts"]
