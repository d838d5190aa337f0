"""Toxicity by a weighted lexicon.

Texts are folded first: case, full-width forms, look-alike letters of other
scripts, and digits or signs that stand for letters inside a word.  Those at
the start or end of a word may as well be a mark, a number or the end of a
sentence, so such a word is read both ways.  An
Aho-Corasick automaton then finds the entries of the lexicon at the start of
words; a hit inside an exception phrase does not count.  The weights found are
normalised by the length of the text and become a probability through a
logistic curve.

The lexicon, its exceptions and the curve are learned by ``fit`` from at most
``max_rows`` labelled documents, those with the smallest hash of their id.  Entries
are whole words of any length and starts of words of ``prefix`` characters (4 to 10:
what inflected forms of a word share; longer words are entries as a whole).  An
entry is in a hundredth of the toxic texts learned from, and an exception in three
others, so that the model grows with the rows learned from and not with the
corpus, and can be broadcast.  Of copies
and near copies with one label only the row with the smallest id teaches; the
lexicon says how many rows were ``left_out`` for that.

Defined cases: a null or empty text has no hits and gets the score of a text
without words; labels that are null or whose document is missing are not used;
without any label, or with labels of one class only, the scores are the share
of that class smoothed by one row of each; columns named like the new ones are
replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import given_back, slices, with_columns_from, written

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Phrases in which an entry of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "idiot proof", "clown fish", "sore loser")

_ODD = re.compile("[" + "".join(HOMOGLYPHS) + "！-～]")
_MIXED = re.compile(r"(?<=[^\W\d_])[013457 8@$!|]*[013457 8@$!|](?=[^\W\d_])".replace(" ", ""))
#: Words with digits or signs before or after them that may stand for letters.
_EDGED = re.compile(r"(?<![^\W_])([013457 8@$!|]{0,3})([^\W\d_](?:[^\W_]*[^\W\d_])?)([013457 8@$!|]*)(?![^\W_])".replace(" ", ""))
#: So many signs at either end of a word can be letters.
EDGE = 3
_GLYPHS = str.maketrans(HOMOGLYPHS | {chr(c): chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)})
_SIGNS = str.maketrans(SUBSTITUTES)
_GAPS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """The folded words of a text, each with one space before and after it."""
    return f" {_GAPS.sub(' ', _inner(text)).strip()} "


def _inner(text: str | None) -> str:
    t = (text or "").lower()
    if not t.isascii() and _ODD.search(t):
        t = t.translate(_GLYPHS)
    return _MIXED.sub(lambda m: m[0].translate(_SIGNS), t)


def edged(text: str | None) -> list[tuple[str, str, str]]:
    """The words of a text with signs before or after them: these signs as letters, and the word."""
    return [(before.translate(_SIGNS), word, after.translate(_SIGNS)) for before, word, after in _EDGED.findall(_inner(text)) if before or after]


@dataclass
class Lexicon:
    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)
    base: float = 0.0
    left_out: int = 0

    def automaton(self) -> ahocorasick.Automaton | None:
        """Keys start with the space before a word; an exception's weight is None."""
        a = ahocorasick.Automaton()
        for term, w in self.terms.items():
            a.add_word(f" {term}", (len(term) + 1, w))
        for phrase in self.exceptions:
            a.add_word(f"{fold(phrase)}", (len(fold(phrase)), None))
        if not len(a):
            return None
        a.make_automaton()
        return a


#: Numbers that the curve is a function of.
N_FEATURES = 4


def _weight(word: str, automaton: ahocorasick.Automaton) -> float:
    """Of the heaviest entry that a single word starts with."""
    return max((w for end, (size, w) in automaton.iter(f" {word} ") if w is not None and end - size + 1 == 0), default=0.0)


def _edge_weight(before: str, word: str, after: str, automaton: ahocorasick.Automaton) -> float:
    """Of the heaviest reading of a word with signs at its edges that stand for letters; 0 if it is a hit without them."""
    if _weight(word, automaton):
        return 0.0
    starts = [before[i:] for i in range(max(0, len(before) - EDGE), len(before) + 1)]
    return max(_weight(start + word + after[:j], automaton) for start in starts for j in range(min(EDGE, len(after)) + 1))


def features(folded: str, automaton: ahocorasick.Automaton | None, edges: list[tuple[str, str, str]] | tuple = ()) -> tuple[float, ...]:
    n = folded.count(" ") - 1 if len(folded) > 2 else 0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded) if automaton is not None else ():
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for a, b in spared:
        for start in [s for s in best if a <= s < b]:
            del best[start]
    if automaton is not None:
        for k, edge in enumerate(edges):
            if weight := _edge_weight(*edge, automaton):
                best[-1 - k] = weight
    total = sum(best.values())
    return math.log(1e-3 + total / (n + 5)), math.log1p(total), float(min(len(best), 3)), math.log1p(n)


def _terms(folded: str, shortest: int, longest: int) -> set[str]:
    found: set[str] = set()
    for w in set(folded.split()):
        found.update(w[:k] for k in range(shortest, min(longest, len(w)) + 1))
        if len(w) >= 3:
            found.add(w + " ")
    return found


def _counts(sample: DataFrame, shortest: int, longest: int) -> DataFrame:
    """In how many toxic and other texts each start of a word and each word (with a space after it) is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500):
                counts: tuple[Counter, Counter] = Counter(), Counter()
                for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                    counts[y].update(_terms(fold(text), shortest, longest))
                for y in (0, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(counts[y].keys(), pa.string()), pa.array([y] * len(counts[y]), pa.int64()), pa.array(counts[y].values(), pa.int64())], names=["term", "y", "n"])

    rows = sample.select("text", "y").mapInArrow(run, "term string, y long, n long")
    return rows.groupBy("term").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("n1"), F.sum(F.expr("if(y = 0, n, 0)")).alias("n0"))


#: Words of a shingle, hashes of a sketch, and the similarity from which a text is a near copy.
SHINGLE, SKETCH, NEAR = 5, 64, 0.75


def _sketch(text: str | None) -> np.ndarray:
    """The smallest hashes of the shingles of the whole text, in order; all of them if they are few."""
    words = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in fold(text).split()], np.uint64)
    size = min(SHINGLE, len(words))
    h = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)[:SKETCH]


def _firsts(sketches: list[np.ndarray]) -> list[int]:
    """The places of the sketches that are no near copy of one before.

    The places kept by hash stand in one array, with room for as many as have the hash; a hash that only one
    sketch has needs no room.
    """
    every = np.sort(np.concatenate([np.empty(0, np.uint64), *sketches]))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    first = np.searchsorted(every, shared)
    rooms = np.searchsorted(every, shared, "right") - first
    start = np.cumsum(rooms) - rooms
    having, filled = np.zeros(rooms.sum(), np.int32), np.zeros(len(shared), np.int32)
    del every, first, rooms
    kept: list[int] = []
    empty = False
    for i, own in enumerate(sketches):
        if not len(own):
            if not empty:
                kept.append(i)
            empty = True
            continue
        at = np.searchsorted(shared, own)
        at = at[at < len(shared)]
        at = at[shared[at] == own[: len(at)]]
        near = [having[a : a + k] for a, k in zip(start[at].tolist(), filled[at].tolist(), strict=True) if k]
        if near:
            others, common = np.unique(np.concatenate(near), return_counts=True)
            # the smallest hashes of the union are a sample of it: the share found in both estimates the similarity
            if any(
                np.isin(union := np.union1d(own, sketches[j])[:SKETCH], np.intersect1d(own, sketches[j])).sum() >= NEAR * len(union)
                for j in others[common >= NEAR * len(own)].tolist()
            ):
                continue
        kept.append(i)
        having[start[at] + filled[at]] = i
        filled[at] += 1
    return kept


def _without_copies(sample: DataFrame) -> tuple[DataFrame, int]:
    """The rows of a written sample (``row``, ``id``, ``y``, ``text``) without near copies of one label, and how many went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([_sketch(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], names=["row", "sketch"])

    sketches = sample.select("row", "text").mapInArrow(run, "row long, sketch binary")
    rows = sorted(sample.select("row", "id", "y").join(sketches, "row").collect(), key=lambda r: (r.id, r.row))
    kept: list[int] = []
    for y in (0, 1):
        own = [r for r in rows if r.y == y]
        kept += [own[i].row for i in _firsts([np.frombuffer(r.sketch, np.uint64) for r in own])]
    ids = sample.sparkSession.createDataFrame([(k,) for k in kept], "row long")
    return sample.join(F.broadcast(ids), "row"), len(rows) - len(kept)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    usable: Callable[[Column], Column] | None = None,
    exceptions: tuple[str, ...] = EXCEPTIONS,
    max_rows: int = 20_000,
    prefix: tuple[int, int] = (4, 10),
) -> Lexicon:
    """Learn from the labelled rows whose id is ``usable``; odd hashes make the lexicon, even ones the curve.

    At most ``max_rows`` rows are taken, and of these the copies and near copies of a row with the same label and a
    smaller id are left out: those that share about ``NEAR`` of the shingles of the whole text, by ``SKETCH`` of their hashes."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if usable is not None:
        ids = ids.where(usable(F.col("id")))
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(ids), "id")
    # copies and near copies of one text would make its own words look like a lexicon
    sample, left_out = _without_copies(written(sample.withColumn("row", F.monotonically_increasing_id()), "toxicity-sample"))
    sample = written(sample, "toxicity-sample")
    n = {(r.part, r.y): r["count"] for r in sample.groupBy(F.expr("pmod(h, 2)").alias("part"), "y").count().collect()}
    n1, n0 = (n.get((1, y), 0) for y in (1, 0))
    all1, all0 = (sum(v for (_, k), v in n.items() if k == y) for y in (1, 0))
    base = math.log((all1 + 1) / (all0 + 1))
    if not (n1 and n0 and n.get((0, 1)) and n.get((0, 0))):
        return Lexicon({}, list(exceptions), [], base, left_out)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1) * (n0 + 1) / (F.col("n0") + 0.5))
    counted = _counts(sample.where(F.expr("pmod(h, 2) = 1")), *prefix).withColumn("w", odds)
    strong = counted.where((F.col("n1") >= max(5, n1 // 100)) & (F.col("w") >= 2.5)).select("term", "w").collect()
    terms = {r.term: r.w for r in strong}
    starts = {t[:k] for t in terms for k in (len(t),) if not t.endswith(" ")}
    harmless = counted.where((F.col("w") <= -0.5) & F.col("term").endswith(" ")).where(F.col("n0") >= 3)
    if starts:
        tops = [s for s in starts if not any(s[:k] in starts for k in range(prefix[0], len(s)))]
        harmless = harmless.where(F.substring("term", 1, prefix[0]).isin(sorted({s[: prefix[0]] for s in tops})))
        found = sorted(r.term.strip() for r in harmless.select("term").collect())
    else:
        found = []
    lexicon = Lexicon(terms, [*exceptions, *found], [], base, left_out)
    seen = _features_of(sample.where(F.expr("pmod(h, 2) = 0")).select("text", "y"), lexicon, "text").select("x", "y").collect()
    lexicon.curve = _logistic(np.array([r.x for r in seen]), np.array([r.y for r in seen], float)).tolist()
    del seen
    given_back()  # the driver's Python lives on
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of the features and, last, the constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return w


def _features_of(docs: DataFrame, lexicon: Lexicon, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make() -> Callable:
        automaton = shared.value.automaton()
        return lambda columns: [[list(features(fold(t), automaton, edged(t))) for t in columns[0]]]

    return with_columns_from(docs, [("x", T.ArrayType(T.DoubleType()))], [text_col], make)


def score(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make() -> Callable:
        model = shared.value
        automaton = model.automaton()

        def f(columns: list[list]) -> list[list]:
            scores = []
            for text in columns[0]:
                z = model.base
                if model.curve:
                    z = sum(a * b for a, b in zip(model.curve, (*features(fold(text), automaton, edged(text)), 1.0), strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            return [scores, [int(s >= threshold) for s in scores]]

        return f

    return with_columns_from(docs, [("score", T.DoubleType()), ("predicted", T.IntegerType())], [text_col], make)
