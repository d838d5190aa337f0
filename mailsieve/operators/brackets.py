"""Sections between separators: which lines they are, and one label for each."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

#: How often each character is in a separator, in the order of the characters.
Shape = tuple[tuple[str, int], ...]


def shape(text: str) -> Shape:
    return tuple(sorted(Counter(text).items()))


def alike(x: Shape, y: Shape) -> bool:
    """Shapes of the same characters whose counts, and their sums, differ by one at most."""
    off = [n - m for (_, n), (_, m) in zip(x, y, strict=False)]
    return [c for c, _ in x] == [c for c, _ in y] and abs(sum(off)) <= 1 and max(map(abs, off), default=0) <= 1


class _Closers:
    """The separators that can still close a section: a queue of places for each shape.

    Sections are opened from the first line on, so a place that is too early for one is too early for all that
    follow, and a queue is only ever read forwards.
    """

    def __init__(self, texts: Sequence[str], at: Sequence[int]):
        self.shape_of = {i: shape(texts[i]) for i in at}
        self.queues: dict[Shape, list[int]] = {}
        self.read: dict[Shape, int] = {}
        by_characters: dict[tuple[str, ...], list[Shape]] = {}
        for i in at:
            own = self.shape_of[i]
            if own not in self.queues:
                by_characters.setdefault(tuple(c for c, _ in own), []).append(own)
            self.queues.setdefault(own, []).append(i)
            self.read[own] = 0
        self.likes = {own: [x for x in group if alike(own, x)] for group in by_characters.values() for own in group}

    def take(self, start: int) -> int | None:
        """The first one that can close what opens at ``start``; no other section gets it."""
        heads = []
        for own in self.likes[self.shape_of[start]]:
            queue = self.queues[own]
            while self.read[own] < len(queue) and queue[self.read[own]] <= start + 1:
                self.read[own] += 1
            if self.read[own] < len(queue):
                heads.append((queue[self.read[own]], own))
        if not heads:
            return None
        end, own = min(heads)
        self.read[own] += 1
        return end


def section_flags(texts: Sequence[str], separators: Sequence[bool], signature: Sequence[bool]) -> tuple[list[bool], list[bool]]:
    """For each line: whether it is inside a section, and whether that holds a line of a signature.

    A section goes from a separator that closes none to the next like it with a line between.  Of several around a
    line the one opened last counts.
    """
    n = len(texts)
    opened_by = np.full(n, -1)
    at = [i for i, s in enumerate(separators) if s]
    if len(at) < 2:
        return [False] * n, [False] * n
    closers, closing = _Closers(texts, at), set()
    signed = np.concatenate([[0], np.cumsum(np.asarray(signature, int))])
    holds = np.zeros(n, bool)
    for start in at:
        if start not in closing and (end := closers.take(start)) is not None:
            closing.add(end)
            opened_by[start + 1 : end] = start
            holds[start] = signed[end] > signed[start + 1]
    inside = opened_by >= 0
    return inside.tolist(), (inside & holds[opened_by]).tolist()


#: Labels that a block between separators may take as a whole.
_WHOLE = ("BODY", "SIGNATURE")


def unified(labels: list[str], separators: Sequence[bool]) -> list[str]:
    """Labels where blocks from one separator to a later one, both included, are all body or all signature if more
    than half of the block is.  Later blocks see what earlier ones changed.

    ``lead`` sums, for either label, one for each line that has it and minus one for each that has not: it is higher
    after a block than before it where the label has the block.
    """
    at = np.flatnonzero(np.asarray(separators, bool))
    if len(labels) < 3 or len(at) < 2:
        return labels
    names = np.array(labels, object)
    step = np.stack([np.where(names == x, 1, -1) for x in _WHOLE])
    lead = np.concatenate([np.zeros((2, 1), int), step.cumsum(1)], axis=1)
    free = np.ones(len(at), bool)
    for k in np.arange(len(at) - 1):
        if not free[k]:
            continue
        start, ends = at[k], at[k + 1 :]
        won = (lead[:, ends + 1] > lead[:, [start]]) & free[k + 1 :] & (ends > start + 1)
        if not won.any():
            continue
        first = int(won.any(0).argmax())
        end, label = ends[first], int(won[:, first].argmax())
        free[k + 1 + first] = False
        names[start : end + 1] = _WHOLE[label]
        step[:, start : end + 1] = -1
        step[label, start : end + 1] = 1
        lead[:, start + 1 :] = lead[:, [start]] + step[:, start:].cumsum(1)
    return names.tolist()


def repaired(labels: list[str], separators: Sequence[bool]) -> list[str]:
    """No closing on a separator (it goes with a signature right after it, else with the body), and none after a signature."""
    n = len(labels)
    if n < 2:
        return labels
    out = [("SIGNATURE" if i + 1 < n and labels[i + 1] == "SIGNATURE" else "BODY") if x == "CLOSING" and separators[i] else x for i, x in enumerate(labels)]
    signed = False
    for i, x in enumerate(out):
        if x == "CLOSING" and signed:
            out[i] = "SIGNATURE"
        signed = signed or x == "SIGNATURE"
    return out


def repaired_native(labels: Column, separators: Column) -> Column:
    """``repaired`` as an expression over two arrays."""

    def both(x: Column) -> Column:
        ys, marks = x["ys"], x["marks"]
        after = lambda y, i: F.when(F.get(ys, i + 1) == "SIGNATURE", "SIGNATURE").otherwise("BODY")
        first = F.transform(ys, lambda y, i: F.when((y == "CLOSING") & F.get(marks, i), after(y, i)).otherwise(y))
        return F.when(F.size(ys) < 2, ys).otherwise(let(first, late))

    def late(ys: Column) -> Column:
        signed = F.array_position(ys, "SIGNATURE")  # from 1, 0 if there is none
        return F.transform(ys, lambda y, i: F.when((y == "CLOSING") & (signed > 0) & (i >= signed), "SIGNATURE").otherwise(y))

    return let(F.struct(labels.alias("ys"), separators.alias("marks")), both)


def unified_blocks(labels: Column, separators: Column) -> Column:
    """``unified`` of two arrays; mails with the same labels and separators are worked on once a batch."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        flat = a.flatten().dictionary_encode()
        codes, names = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
        code = {y: k for k, y in enumerate(dict.fromkeys([*names, *_WHOLE]))}
        marks = b.flatten().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        out, seen = codes.copy(), {}
        for start, end in zip(offsets, offsets[1:], strict=False):
            key = codes[start:end].tobytes(), marks[start:end].tobytes()
            if (found := seen.get(key)) is None:
                found = seen[key] = [code[y] for y in unified([names[k] for k in codes[start:end]], marks[start:end])]
            out[start:end] = found
        ends = pa.array(offsets, pa.int32(), mask=np.append(a.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(ends, pa.array([*code], pa.string()).take(pa.array(out)))

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>").asNondeterministic()(labels, separators)
