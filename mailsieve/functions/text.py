"""White space, lines and character classes, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that is stripped, as the inside of a character class.
WS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same white space, character by character.
WS_CHARS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Invisible characters that are removed.
ZERO_WIDTH = "﻿​‌‍⁠"

#: Code points by class, as the inside of a character class (those that are not here, and not ASCII, are symbols).
KANJI = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FA6D}\x{FA70}-\x{FAD9}\x{1F210}-\x{1F212}\x{1F214}-\x{1F23B}\x{1F240}-\x{1F248}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B739}\x{2B740}-\x{2B81D}\x{2B820}-\x{2CEA1}\x{2CEB0}-\x{2EBE0}\x{2EBF0}-\x{2EE5D}\x{2F800}-\x{2FA1D}\x{30000}-\x{3134A}\x{31350}-\x{323AF}"
HIRAGANA = r"\x{3041}-\x{3096}\x{3099}-\x{30A0}\x{30FC}\x{FF70}\x{1B001}\x{1B11F}\x{1B132}\x{1B150}-\x{1B152}\x{1F200}"
KATAKANA = r"\x{30A1}-\x{30FB}\x{30FD}-\x{30FF}\x{31F0}-\x{31FF}\x{32D0}-\x{32FE}\x{FF65}-\x{FF6F}\x{FF71}-\x{FF9F}\x{1B000}\x{1B120}-\x{1B122}\x{1B155}\x{1B164}-\x{1B167}\x{1F201}-\x{1F202}\x{1F213}"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(found: Column, name: str) -> Column:
    """A field of what an Arrow function returned.  The call is named twice, so that it stays a step of its own: Spark
    moves what is named once into an explode, where it can't run such a function."""
    return F.when(found.isNotNull(), found[name])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def newlines(text: Column) -> Column:
    """All line ends as line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def trim_blank_lines(lines: Column) -> Column:
    """Stripped lines without the empty ones at both ends; those between stay."""
    ends = lambda ls: F.transform(ls, lambda x, i: F.when(x != "", i))
    cut = lambda ls, full: F.when(F.array_min(full).isNull(), F.array().cast("array<string>")).otherwise(F.slice(ls, F.array_min(full) + 1, F.array_max(full) - F.array_min(full) + 1))
    return let(lines, lambda ls: let(ends(ls), lambda full: cut(ls, full)))


def class_shares(text: Column) -> Column:
    """A struct of the shares of the six classes of characters; 0 in an empty text.  Each class is counted once."""
    count = lambda inside: F.length(text) - F.length(F.regexp_replace(text, f"[{inside}]+", ""))
    found = {"kanji_ratio": count(KANJI), "hiragana_ratio": count(HIRAGANA), "katakana_ratio": count(KATAKANA), "ascii_ratio": count("A-Za-z"), "digit_ratio": count("0-9" + OTHER_DIGITS)}

    def shares(k: Column) -> Column:
        share = lambda x: F.when(k["n"] == 0, F.lit(0.0)).otherwise(x / k["n"])
        rest = reduce(Column.__sub__, (k[name] for name in found), k["n"])
        return F.struct(*(share(k[name]).alias(name) for name in found), share(rest).alias("symbol_ratio"))

    return let(F.struct(F.length(text).alias("n"), *(v.alias(name) for name, v in found.items())), shares)


def class_ratios(text: Column) -> dict[str, Column]:
    """The fields of ``class_shares`` by name."""
    shares = class_shares(text)
    return {name: shares[name] for name in ("kanji_ratio", "hiragana_ratio", "katakana_ratio", "ascii_ratio", "digit_ratio", "symbol_ratio")}


#: Digits outside ASCII: superscripts, full-width and the other scripts' ranges of ten.
_TENS = (0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xDE6, 0xE50, 0xED0, 0xF20, 0x1040, 0x1090, 0x17E0, 0x1810, 0x1946, 0x19D0, 0x1A80, 0x1A90, 0x1B50, 0x1BB0, 0x1C40, 0x1C50, 0xA620, 0xA8D0, 0xA900, 0xA9D0, 0xA9F0, 0xAA50, 0xABF0, 0xFF10)
OTHER_DIGITS = r"\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}" + "".join(rf"\x{{{a:X}}}-\x{{{a + 9:X}}}" for a in _TENS)
