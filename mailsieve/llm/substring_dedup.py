"""Substring dedup by hashes of lines and sentences.

Each line of at least ``min_words`` words is a unit, and so is each sentence of
that size in a line of several, so that a passage is found whether it is a line
of its own or inside one.  Shorter lines and sentences that follow each other
make a run, and windows over a run are units of their own: from each line or
sentence on, and up to each, as few as have ``min_chars`` characters.  So a
passage of short lines or sentences, or of text without spaces, is found
wherever it stands in a run.  Units are normalised (A-Z lower-cased, white space
to single spaces) and only their 128-bit digests travel.  They are grouped
globally; the occurrence earliest by rank, id and offset stays and all others
are cut out of their texts, at offsets of the original that the result keeps.
A window that overlaps the one that stays is not cut.

A unit may be in a third of all documents: counts and minima are summed before
the shuffle, and the join back to the occurrences is one whose large partitions
Spark splits.

Defined cases: a null or empty text has no units and stays; repeats inside one
document go too; rows with the same id are one document, equal units at equal
offsets of it are one occurrence, and where their texts differ each row loses only
units that it has itself; a null id or rank comes first; columns named
like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import returned, slices, with_columns_from, written

_SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")
#: The same for lines of few words, which may have no spaces at all.
_SHORT = re.compile(r"[^.!?。！？]+[.!?。！？]*|[.!?。！？]+")
_NO_ID = -(2**63)
#: Bytes of a window's digest; those of lines and sentences have 16.
_RUN_BYTES = 15


def _words(piece: str) -> list[bytes]:
    return piece.encode("utf-8", "surrogatepass").lower().split()


def _digest(piece: str, min_words: int) -> bytes | None:
    words = _words(piece)
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if len(words) >= min_words else None


def units(text: str, min_words: int) -> Iterator[tuple[int, int, bytes | None, list[tuple[int, int, bytes | None]]]]:
    """Lines: start, end, digest if it is a unit, and the sentences likewise."""
    start = 0
    for line in text.split("\n"):
        own = _digest(line, min_words)
        inner = []
        if own is not None:
            for m in _SENTENCE.finditer(line):
                key = _digest(m[0], min_words)
                inner.append((start + m.start(), start + m.end(), None if key == own else key))
        yield start, start + len(line), own, inner
        start += len(line) + 1


def windows(text: str, min_words: int, min_chars: int) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Windows over the runs of short lines and sentences: the places of their parts, and the digest."""
    start, run = 0, []
    for line in text.split("\n"):
        for m in (_SENTENCE if len(_words(line)) >= min_words else _SHORT).finditer(line):
            words = _words(m[0])
            if len(words) >= min_words:
                yield from _windows_of(run, min_chars)
                run = []
            elif words:
                run.append((start + m.start(), start + m.end(), b" ".join(words)))
        start += len(line) + 1
    yield from _windows_of(run, min_chars)


def _windows_of(run: list[tuple[int, int, bytes]], min_chars: int) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    sizes = [len(words.decode("utf-8", "surrogatepass")) for _, _, words in run]
    if sum(sizes) < min_chars:
        return
    found = set()
    j = total = 0
    for i in range(len(run)):
        while j < len(run) and total < min_chars:
            total += sizes[j]
            j += 1
        if total < min_chars:
            break
        found.add((i, j))
        total -= sizes[i]
    i, total = len(run), 0
    for j in range(len(run), 0, -1):
        while i > 0 and total < min_chars:
            i -= 1
            total += sizes[i]
        if total < min_chars:
            break
        found.add((i, j))
        total -= sizes[j - 1]
    for i, j in sorted(found):
        yield [(a, b) for a, b, _ in run[i:j]], hashlib.blake2b(b" ".join(words for _, _, words in run[i:j]), digest_size=_RUN_BYTES).digest()


def _occurrences(docs: DataFrame, min_words: int, min_chars: int | None) -> DataFrame:
    """From ``r``, ``doc`` and ``text``: each unit's digest, rank, document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200):
                out: tuple[list, ...] = [], [], [], [], []
                for rank, doc, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if not text:
                        continue
                    for a, b, own, inner in units(text, min_words):
                        for x, y, key in ((a, b, own), *inner):
                            if key is not None:
                                for column, v in zip(out, (key, rank, doc, x, y), strict=True):
                                    column.append(v)
                    for parts, key in windows(text, min_words, min_chars) if min_chars else ():
                        for column, v in zip(out, (key, rank, doc, parts[0][0], parts[-1][1]), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["k", "r", "doc", "a", "b"])

    return docs.mapInArrow(returned(run), "k binary, r long, doc long, a int, b int")


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = 8, min_chars: int | None = 80) -> DataFrame:
    """``docs`` with the text cut, ``n_units``, ``n_removed``, ``removed`` (start and end in the original text and the
    document that keeps the unit) and ``kept_spans`` (start and end of what is left).

    Without ``min_chars`` only lines and sentences of ``min_words`` words are compared."""
    doc = F.coalesce(F.col(id_col), F.lit(_NO_ID)).cast("long")
    rank = F.coalesce(F.col(rank_col), F.lit(_NO_ID)).cast("long") if rank_col else F.lit(0).cast("long")
    places = written(_occurrences(docs.select(rank.alias("r"), doc.alias("doc"), F.col(text_col).alias("text")), min_words, min_chars), "unit-places")
    first = places.groupBy("k").agg(F.min(F.struct("r", "doc", "a", "b")).alias("f"), F.max(F.struct("r", "doc", "a", "b")).alias("l"))
    common = written(first.where("f < l").select("k", F.col("f.doc").alias("first_doc"), F.col("f").alias("f")), "unit-common")
    run = F.length("k") == _RUN_BYTES
    beside = run & (F.col("r") == F.col("f.r")) & (F.col("doc") == F.col("f.doc")) & (F.col("a") < F.col("f.b"))
    again = places.join(common, "k").where((F.struct("r", "doc", "a", "b") != F.col("f")) & ~beside)
    gone = again.groupBy("doc").agg(F.collect_set(F.struct("a", "b", "first_doc", "k")).alias("__gone"))
    gone = written(gone.withColumnRenamed("doc", "__doc"), "unit-gone")
    joined = docs.withColumn("__id", doc).join(gone.hint("shuffle_hash"), F.col("__id") == F.col("__doc"), "left").drop("__doc", "__id")

    def make() -> Callable:
        def f(columns: list[list]) -> list[list]:
            return [list(c) for c in zip(*(_cut(t, g, min_words, min_chars) for t, g in zip(*columns, strict=True)), strict=True)] or [[]] * 5

        return f

    span = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    removed = T.ArrayType(T.StructType([*span, T.StructField("first_doc", T.LongType())]))
    fields = [("__text", T.StringType()), ("n_units", T.LongType()), ("n_removed", T.LongType()), ("removed", removed), ("kept_spans", T.ArrayType(T.StructType(span)))]
    out = with_columns_from(joined, fields, [text_col, "__gone"], make, drop=[text_col, "__gone"])
    new = ("n_units", "n_removed", "removed", "kept_spans")
    return out.select(*(F.col("__text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in new), *new)


def _cut(text: str | None, gone: list[dict] | None, min_words: int, min_chars: int | None) -> tuple:
    if not text:
        return text, 0, 0, [], []
    # rows with one id share their marks: a unit goes only where it has the digest too
    marked = {(g["a"], g["b"], bytes(g["k"])): g["first_doc"] for g in gone or ()}
    n = 0
    parts_gone: dict[tuple[int, int], int] = {}
    for parts, key in windows(text, min_words, min_chars) if min_chars else ():
        n += 1
        if (place := (parts[0][0], parts[-1][1], key)) in marked:
            for part in parts:
                parts_gone.setdefault(part, marked[place])
    short = sorted((x, y, first) for (x, y), first in parts_gone.items())
    at_short = 0
    removed: list[dict] = []
    kept: list[list[int]] = []
    lines: list[str] = []
    for a, b, own, inner in units(text, min_words):
        n += (own is not None) + sum(k is not None for _, _, k in inner)
        here = at_short
        while at_short < len(short) and short[at_short][0] < b:
            at_short += 1
        if own is not None and (a, b, own) in marked:
            removed.append({"start": a, "end": b, "first_doc": marked[a, b, own]})
            continue
        cuts = [[x, y, marked[x, y, key]] for x, y, key in inner if key is not None and (x, y, key) in marked]
        if at_short > here:
            cuts = sorted([*cuts, *map(list, short[here:at_short])])
            if not "".join(text[x:y] for x, y in zip((a, *(c[1] for c in cuts)), (*(c[0] for c in cuts), b), strict=True)).strip():
                cuts[0][0] = a  # only white space would be left of the line: it goes too
                for c, end in zip(cuts, [*(c[0] for c in cuts[1:]), b], strict=True):
                    c[1] = end
                removed += [{"start": x, "end": y, "first_doc": first} for x, y, first in cuts]
                continue
        left, at = [], a
        for x, y, first in cuts:
            removed.append({"start": x, "end": y, "first_doc": first})
            if x > at:
                left.append([at, x])
            at = y
        if b > at or a == b:
            left.append([at, b])
        kept += left
        lines.append("".join(text[x:y] for x, y in left))
    return "\n".join(lines), n, len(removed), removed, [{"start": x, "end": y} for x, y in kept]
