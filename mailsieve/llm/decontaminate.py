"""Benchmark decontamination.

The words of the benchmark items are cut into windows (n-grams).  A hash set of
the windows is broadcast; every document is scanned once for windows with these
hashes, each candidate is verified word by word, and the spans found, or the
documents, can be removed.  Nothing is shuffled.

The broadcast set is bounded: items are dealt into blocks of at most
``block_chars`` characters of text (16 million, about 80 MB of windows in a
worker), and each block makes a pass of its own, over the written result of the
one before, that adds to its hits.  So a benchmark of any size runs in the memory
of one block, on the driver and in the workers.

Defined cases: a null or wordless text has no words and no hits; an item with a
null id or without words is no item; items with the same id count once; rows
repeated in the documents each give a row; columns of the documents that are
named like a new column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import with_columns_from, written
from .jaccard import WordHasher

#: Lower-cases A-Z and turns every byte that belongs to no word into a space.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def _translated(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS)


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` words, from the hashes of the words."""
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class WindowIndex:
    """The windows of items by a hash: for each size of window a sorted array of hashes, and of each the item and the
    place in it.  An equal hash only makes a candidate, which is compared with the words of the item.

    A window takes 16 bytes, and the words of the items are kept as text, which is about five bytes a character.
    """

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.hasher = WordHasher()
        self.names: list[str] = []
        self.texts: list[bytes] = []
        self.starts: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            joined = b" ".join(words)
            size = min(n, len(words))
            found.setdefault(size, []).append((_mixed(self.hasher.words(joined), size), len(self.names)))
            self.names.append(item)
            self.texts.append(joined)
            self.starts.append(np.cumsum([0, *(len(w) + 1 for w in words)]).astype(np.int32))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, own in found.items():
            hashes = np.concatenate([h for h, _ in own])
            order = np.argsort(hashes, kind="stable")
            whose = np.repeat(np.array([k for _, k in own], np.int32), [len(h) for h, _ in own])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in own])
            self.windows[size] = hashes[order], whose[order], place[order]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """How many words a text has, start and end, in words, of every window that occurs, and the items they are from."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        raw = _translated(text) if text else b""
        h = self.hasher.words(raw)
        words: list[bytes] = []
        for size, (hashes, whose, place) in self.windows.items():
            own = _mixed(h, size)
            first = np.searchsorted(hashes, own)
            for at in np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == own).tolist():
                words = words or raw.split()
                window = b" ".join(words[at : at + size])
                k = int(first[at])
                while k < len(hashes) and hashes[k] == own[at]:
                    item, start = int(whose[k]), int(place[k])
                    if self.texts[item][self.starts[item][start] : self.starts[item][start + size] - 1] == window:
                        spans.append((at, at + size))
                        found.add(self.names[item])
                    k += 1
        return len(h), spans, found


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _char_spans(text: str, spans: list[list[int]]) -> list[list[int]]:
    """Spans of words as offsets in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_TO_WORDS))]
    size = lambda a, b: len(raw[a:b].decode("utf-8", "surrogatepass"))
    out, done, chars = [], 0, 0
    for a, b in spans:
        start, end = at[a][0], at[b - 1][1]
        chars += size(done, start)
        width = size(start, end)
        out.append([chars, chars + width])
        chars, done = chars + width, end
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ``block_chars`` characters, or one item; the driver holds one block at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    block: list[tuple[str, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    n: int = 10,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = 16_000_000,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``item_ids`` (sorted), ``hit_words`` and ``hit_spans`` (merged
    spans, the first in words, the second as offsets in code points) and ``contaminated``."""
    spark = docs.sparkSession
    spans_type = T.ArrayType(T.ArrayType(T.IntegerType()))
    fields = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("item_ids", T.ArrayType(T.StringType())), ("hit_words", spans_type), ("hit_spans", spans_type), ("contaminated", T.BooleanType())]
    out = docs
    for k, block in enumerate(blocks_of(benchmark, item_id_col, item_text_col, block_chars)):
        if k:  # a stage of its own, so that no worker has the windows of two blocks
            out = written(out, "decontamination")
        items = spark.sparkContext.broadcast(block)

        def make(items=items, first=k == 0) -> Callable:
            index = WindowIndex(items.value, n)

            def f(columns: list[list]) -> list[list]:
                rows = []
                for text, ids, before in zip(columns[0], *(columns[1:] or ([()] * len(columns[0]),) * 2), strict=True):
                    n_words, spans, found = index.scan(text)
                    if not first:
                        spans = [*spans, *map(tuple, before)]
                        found = found | set(ids)
                    spans = merged(spans)
                    hit = sum(b - a for a, b in spans)
                    rows.append((n_words, hit, sorted(found), spans, _char_spans(text, spans) if spans else [], hit > 0))
                return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields]

            return f

        out = with_columns_from(out, fields, [text_col] if k == 0 else [text_col, "item_ids", "hit_words"], make)
    return out


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text_col: str = "text", **kw) -> DataFrame:
    """The columns of ``docs`` without the contaminated documents, or with the spans cut out of their texts."""
    found = find_contamination(docs, benchmark, text_col=text_col, **kw)
    if mode == "documents":
        return found.where(~F.col("contaminated")).select(*docs.columns)
    if mode != "spans":
        raise ValueError(mode)

    def make() -> Callable:
        def f(columns: list[list]) -> list[list]:
            out = []
            for text, spans in zip(*columns, strict=True):
                for a, b in reversed(spans or ()):
                    text = text[:a] + text[b:]
                out.append(text)
            return [out]

        return f

    clean = with_columns_from(found, [("__clean", T.StringType())], [text_col, "hit_spans"], make)
    return clean.select(*(F.col("__clean").alias(c) if c == text_col else F.col(c) for c in docs.columns))


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
