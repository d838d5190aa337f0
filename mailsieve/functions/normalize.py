"""Normalisation of a mail's text to lines."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import CodePoints, Lines, PointTable, filled, split
from .text import WS, WS_CHARS, ZERO_WIDTH, newlines, split_lines, strip, trim_blank_lines

#: Dashes that a line of delimiters has as ``-`` and other text as one prolonged sound mark.
LONG_MARKS = "﹣－ｰ—―─━ー"
#: What a line of delimiters may consist of.
DELIMITERS = LONG_MARKS + "★☆◆◇■□●○▲△▼▽" + "【】〔〕「」『』《》〈〉" + "="
#: Hyphens, runs of which become one ``-``.
HYPHENS = "˗֊‐‑‒–⁃⁻₋−"
#: Tildes, which go.
TILDES = "~∼∾〜〰～"

_WIDE = str.maketrans({**{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5E)}, "　": " ", "’": "'", "”": '"', "￥": "¥"})
_JAPANESE = "　-〿぀-ゟ゠-ヿ一-鿿＀-￯"
_HYPHENS, _MARKS, _TILDES = re.compile(f"[{HYPHENS}]+"), re.compile(f"[{LONG_MARKS}]+"), re.compile(f"[{TILDES}]")
_HALF = re.compile("[｡-ﾟ]+")
_SPACES = re.compile(" {2,}")
_AFTER, _BEFORE = re.compile(f"(?<=[{_JAPANESE}]) +"), re.compile(f"(?<=[!-~]) +(?=[{_JAPANESE}])")
_ZERO = re.compile(f"[{ZERO_WIDTH}]")


def japanese(line: str) -> str:
    """One line with widths, dashes and spaces unified, then in compatibility form (NFKC), without invisible characters."""
    if line.isascii():
        return _SPACES.sub(" ", line.replace("~", "")).strip(" ")
    s = _TILDES.sub("", _MARKS.sub("ー", _HYPHENS.sub("-", line)))
    s = _HALF.sub(lambda m: unicodedata.normalize("NFKC", m[0]), s.translate(_WIDE))
    s = _BEFORE.sub("", _AFTER.sub("", _SPACES.sub(" ", s).strip(" ")))
    return _ZERO.sub("", unicodedata.normalize("NFKC", s))


def _japanese_lines(lines: pa.Array) -> pa.Array:
    flat = lines.flatten().to_pylist()
    seen: dict[str, str] = {}
    out = []
    for x in flat:
        if x is None:
            out.append(None)
        else:
            if (y := seen.get(x)) is None:
                y = seen[x] = japanese(x)
            out.append(y)
    offsets = lines.offsets
    if lines.null_count:
        keep = pa.array([None if not v else o for v, o in zip(lines.is_valid().to_pylist(), offsets.to_pylist(), strict=False)] + [offsets[-1].as_py()], pa.int32())
        return pa.ListArray.from_arrays(keep, pa.array(out, pa.string()))
    first = offsets[0].as_py()
    return pa.ListArray.from_arrays(pa.array([o - first for o in offsets.to_pylist()], pa.int32()), pa.array(out, pa.string()))


def japanese_lines(lines: Column) -> Column:
    """``japanese`` of each line of an array; null lines stay null."""

    def run(x: pa.Array) -> pa.Array:
        return _japanese_lines(x)

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>").asNondeterministic()(lines)  # so that it runs once, where it stands


def without_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def is_delimiter_line(line: Column) -> Column:
    return strip(without_zero_width(line)).rlike(f"^[{DELIMITERS}]+$")


def delimiter_line(line: Column) -> Column:
    """A line of delimiters with its dashes as ``-``."""
    return strip(F.translate(without_zero_width(line), LONG_MARKS, "-" * len(LONG_MARKS)))


def unified_dashes(line: Column) -> Column:
    """A line of ``-`` and prolonged sound marks only becomes a line of the more frequent one; ``-`` if there are as many."""
    s = strip(line)
    hyphens, marks = F.length(F.regexp_replace(s, "[^-]", "")), F.length(F.regexp_replace(s, "[^ー]", ""))
    both = F.repeat(F.when(hyphens >= marks, F.lit("-")).otherwise(F.lit("ー")), F.length(s))
    outer = F.concat(F.regexp_extract(line, f"^[{WS}]*", 0), both, F.regexp_extract(line, f"[{WS}]*$", 0))
    return F.when(s.rlike("^[-ー]+$"), outer).otherwise(line)


_TO_HYPHEN = str.maketrans(dict.fromkeys(LONG_MARKS, "-"))
#: Characters that some step of the normalisation may move, of those that are their own compatibility form; spaces apart.
_MOVED = {*LONG_MARKS, *HYPHENS, *TILDES, *ZERO_WIDTH, *WS_CHARS, *map(chr, _WIDE)} - {" "}
_ODD, _SPACE, _DASH = 1, 2, 4


def _with_dashes(line: str, rest) -> str:
    """A line of delimiters with its dashes as ``-``, others by ``rest``; stripped, and with dashes of one kind if it has nothing else."""
    bare = _ZERO.sub("", line)
    inside = bare.strip(WS_CHARS)
    s = inside.translate(_TO_HYPHEN) if inside and not inside.strip(DELIMITERS) else rest(line).strip(WS_CHARS)
    if s and not s.strip("-ー"):
        return ("-" if s.count("-") >= s.count("ー") else "ー") * len(s)
    return s


def normalized_line(line: str) -> str:
    """One line normalised and stripped."""
    return _with_dashes(line, japanese)


def unified_line(line: str) -> str:
    """One line with its dashes unified and without invisible characters, stripped."""
    return _with_dashes(line, lambda x: _ZERO.sub("", x))


def _moves(chars: list[str]) -> np.ndarray:
    """What may happen to characters; those are odd, too, that may join the one before them."""

    def one(c: str) -> int:
        odd = c in _MOVED or unicodedata.category(c)[0] == "M" or "\u1100" <= c <= "\u11ff" or unicodedata.normalize("NFKC", c) != c
        return _ODD * odd | _SPACE * (c == " ") | _DASH * (c in LONG_MARKS or c in ZERO_WIDTH)

    return np.array([one(c) for c in chars], np.uint8)


_moving = PointTable(_moves)


def _replaced(texts: pa.Array, at: np.ndarray, made: pa.Array) -> pa.Array:
    return pc.replace_with_mask(texts, pa.array(at), made.cast(texts.type))


def _one_by_one(texts: pa.Array, at: np.ndarray, by) -> pa.Array:
    return _replaced(texts, at, pa.array([by(x) for x in texts.filter(pa.array(at)).to_pylist()], pa.string())) if at.any() else texts


def normalized_texts(texts: pa.Array) -> pa.Array:
    """``normalized_line`` of each text; those without a character that may move are taken as they are, and those with
    no other one than spaces have them removed together."""
    points = CodePoints(texts)
    kinds = _moving(points.points)
    odd = points.count((kinds & _ODD) > 0) > 0
    spaced = ~odd & (points.count((kinds & _SPACE) > 0) > 0)
    out = _one_by_one(texts, odd, normalized_line)
    if spaced.any():
        s = pc.utf8_trim(pc.replace_substring_regex(texts.filter(pa.array(spaced)), " {2,}", " "), characters=" ")
        s = pc.replace_substring_regex(s, f"([{_JAPANESE}]) +", r"\1")
        out = _replaced(out, spaced, pc.replace_substring_regex(s, f"([!-~]) +([{_JAPANESE}])", r"\1\2"))
    return out


def unified_texts(texts: pa.Array) -> pa.Array:
    """``unified_line`` of each text."""
    points = CodePoints(texts)
    return _one_by_one(pc.utf8_trim(texts, characters=WS_CHARS), points.count((_moving(points.points) & _DASH) > 0) > 0, unified_line)


def unified_lines(line: Column) -> Column:
    """``unified_line`` of a column; each distinct line of a batch once."""

    def run(x: pa.Array) -> pa.Array:
        d = x.cast(pa.string()).dictionary_encode()
        return unified_texts(d.dictionary).take(d.indices)

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string").asNondeterministic()(line)


def normalized_batch(text: pa.Array) -> Lines:
    """The normalised lines of mails, without blank ones at the ends; none of a null or blank mail."""
    full = pc.not_equal(pc.utf8_trim(text, characters=WS_CHARS), "")
    usable = pc.if_else(pc.fill_null(full, False), text, "")
    if pc.any(pc.match_substring(usable, "\r")).as_py():
        usable = pc.replace_substring_regex(usable, "\r\n?", "\n")
    own = split(usable)
    own = Lines(own.offsets, own.ids, normalized_texts(own.texts))
    some = filled(own.texts)[own.ids] if len(own.ids) else np.zeros(0, bool)
    start, end = own.first(some, 0), own.last(some, -1)
    return own.where((own.place >= np.repeat(start, own.sizes)) & (own.place <= np.repeat(end, own.sizes)))


def normalized(lines: Column) -> Column:
    """Each of an array of lines normalised and stripped; null lines stay null."""

    def run(x: pa.Array) -> pa.Array:
        flat = x.flatten().cast(pa.string()).dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ends = pa.array(offsets, pa.int32(), mask=np.append(x.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(ends, normalized_texts(flat.dictionary).take(flat.indices))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>").asNondeterministic()(lines)  # so that it runs once, where it stands


def normalized_lines(text: Column) -> Column:
    """The lines of a mail, normalised and stripped."""
    return normalized(split_lines(newlines(F.coalesce(text, F.lit("")))))


def trimmed(lines: Column) -> Column:
    return trim_blank_lines(lines)
