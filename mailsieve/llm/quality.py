"""Quality rules, lines first.

Every line is judged by itself: decorated words (``word***``), shouting, words
that only repeat, rows of menu entries, and boilerplate.  Lines that fail are
removed, and a document is rejected when the removed lines held more than
``max_lost`` of its words.  Two base rules over the whole text (too few words,
too many words in repeated windows) reject a document before that.

Defined cases: a null text counts as empty, which fails the base rule; columns
named like the new ones are replaced; each row is judged by itself, so repeated
rows each get the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import with_columns_from

_SYMBOLS = b"#*$%&|<>"
#: Openings of lines that are about the page and not part of its text.
BOILERPLATE = re.compile(
    rb"^\s*(?:licensed under|all rights reserved|copyright|\(c\) \d{4}|terms of (?:use|service)|privacy policy|cookie|sign in|log in|subscribe|share (?:this|on)|follow us|read more|click here)\b",
    re.IGNORECASE,
)
_DECORATED = re.compile(rb"[#*$%&!]{2,}$")
_BIG = 0x9E3779B97F4A7C15


def line_fault(line: bytes) -> str | None:
    """Why a line is no prose, or None.  A line without words has no fault."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if BOILERPLATE.match(line):
        return "boilerplate"
    if n >= 3:
        bars = line.count(b"|") + line.count(b" > ") + line.count("»".encode()) + line.count("·".encode())
        if bars * 3 >= n:
            return "navigation"
        if 2 * sum(1 for w in words if _DECORATED.search(w)) >= n:
            return "punctuation"
    if n >= 8:
        if 5 * len(set(words)) <= 2 * n or 2 * sum(a == b for a, b in zip(words, words[1:], strict=False)) >= n:
            return "repetition"
        text = line.decode("utf-8", "surrogatepass")
        letters = [c for c in text if c.isalpha()]
        if letters and 10 * sum(c.isupper() for c in letters) >= 9 * len(letters):
            return "shouting"
    return None


def repeated_words(words: list[bytes], n: int = 8) -> int:
    """Words that are in a window of ``n`` words which occurs twice or more in the text."""
    size = len(words)
    if size <= n:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, size)
    if len(ids) == size:
        return 0
    # windows are told apart by 64 bits mixed from the exact codes; equal ones are then compared word by word
    h = np.zeros(size - n + 1, np.uint64)
    mixed = (code + np.uint64(1)) * np.uint64(_BIG)
    mixed ^= mixed >> np.uint64(29)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + size - n + 1]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    a, b = order[:-1][same], order[1:][same]
    equal = np.ones(len(a), bool)
    for k in range(n):
        equal &= code[a + k] == code[b + k]
    twice[a[equal]] = twice[b[equal]] = True
    edge = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None, *, min_words: int, max_repeat: float, max_lost: float) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    body = b"".join(words)
    chars = len(body.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    lost = 0
    kept: list[bytes] = []
    for line in lines:
        if line.strip():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
        if line_fault(line):
            lost += len(line.split())
        else:
            kept.append(line)
    repeat = repeated_words(words)
    failed = n < min_words or 100 * repeat > 100 * max_repeat * n
    keep = not failed and lost <= max_lost * n
    clean = None if text is None else b"\n".join(kept).decode("utf-8", "surrogatepass")
    return n, chars, symbols, dup, repeat, failed, lost, keep, clean


def quality_rules(docs: DataFrame, *, text_col: str = "text", min_words: int = 20, max_repeat: float = 0.30, max_lost: float = 0.30) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``n_lost_words``, ``kept`` and ``clean_text`` (the lines that passed)."""
    long, flag = T.LongType(), T.BooleanType()
    fields = [("n_words", long), ("word_chars", long), ("n_symbols", long), ("n_dup_lines", long), ("n_repeat_words", long), ("base_failed", flag), ("n_lost_words", long), ("kept", flag), ("clean_text", T.StringType())]

    def make() -> Callable:
        def f(columns: list[list]) -> list[list]:
            rows = [measure(t, min_words=min_words, max_repeat=max_repeat, max_lost=max_lost) for t in columns[0]]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields]

        return f

    return with_columns_from(docs, fields, [text_col], make)
