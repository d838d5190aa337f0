"""SentencePiece encoding and decoding with the N best segmentations.

The pieces of a model that lie in a text make a lattice.  A forward Viterbi
pass gives the best score from the start to each position; these scores are
exact heuristics for an A-star search that walks the lattice backwards from the
end, so complete paths leave its agenda in the order of their scores.

A lattice falls apart where no piece of the vocabulary can cross: before a
space mark, and between characters that no piece has side by side.  These cuts
are derived from the vocabulary when the model is loaded.  Each part is searched
once and remembered, and the N best of a whole text are put together from the
N best of the parts: only the N - 1 parts with the smallest loss of their second
best can take part, which keeps the result exact at a cost that grows with the
length of the text only.

Scores are log probabilities.  A vocabulary of merges (BPE) gives ranks instead,
whose sums mean nothing; they become log probabilities by Zipf's law, as the ranks
follow the frequencies.  The segmentation is then the likeliest one, which need not
be the one that the merges make.

Characters that are in no piece become byte pieces, at the smallest score less
ten.  A space mark (U+2581) in the text itself does so too, so that decoding
gives back each text as it was.  Of equal segmentations the same one is taken on
every run.

Defined cases: a text without any place to cut is searched as one part, in time and
memory that grow with its length; a null or empty text has no pieces, a score of 0 and no
alternatives, and decodes to the empty text; rows repeated each give a row;
columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import with_columns_from

MARK = "▁"
#: Stands for a space mark of the text itself while it is cut; no piece has it.
_LITERAL = ""
_WORST = float("-inf")
#: Scores are multiples of one over this.
_STEPS = 1 << 20
#: Parts of more characters are searched one by one.
_LONG = 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: list[str], n: int) -> np.ndarray:
    """The characters of texts of one length, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), n)


@dataclass
class Encoded:
    """The best ids of some texts one after the other, where each text begins and the last ends, the scores, and for each
    text its N - 1 next best: the score and what it has in place of the best ids (position, how many, which instead)."""

    ids: np.ndarray
    ends: np.ndarray
    scores: np.ndarray
    others: list[list[tuple[float, list[tuple[int, int, list[int]]]]]]


def log_probability(rank: float, offset: float = 2.7) -> float:
    """Of a piece by its rank in a vocabulary ordered by frequency (Zipf's law with Mandelbrot's offset; not normalised)."""
    return -math.log(rank + offset)


class PieceModel:
    def __init__(self, data: bytes, n_best: int = 4, cache_size: int = 150_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.n_best, self.cache_size = n_best, cache_size
        self.scores: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            plain = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            else:
                if plain:
                    self.scores[piece] = (i, sp.get_score(i))
                self.text.append(piece.replace(MARK, " ").encode() if plain else b"")
        if len(self.bytes) < 256:
            raise ValueError("the model has no piece for some byte")
        self._weigh()
        ends = np.cumsum([0, *map(len, self.text)])
        self._bytes, self._byte_at = np.frombuffer(b"".join(self.text), np.uint8), ends
        self._parts = re.compile(self._pattern())
        self._index()
        #: pieces, and False for what only starts one
        self._starts: dict[str, tuple[int, float] | bool] = {p[:k]: False for p in self.scores for k in range(1, len(p))} | self.scores
        self.forget()

    def _weigh(self) -> None:
        """Make scores log probabilities, in whole steps so that sums are exact.

        A vocabulary of merges has minus the rank of each piece as its score, which says nothing about sums; its ranks
        follow the frequencies.  Others have log probabilities.
        """
        if all(s == int(s) for _, s in self.scores.values()):
            total = math.log(sum(math.exp(log_probability(-s)) for _, s in self.scores.values()))
            self.scores = {p: (i, log_probability(-s) - total) for p, (i, s) in self.scores.items()}
        self.scores = {p: (i, round(s * _STEPS) / _STEPS) for p, (i, s) in self.scores.items()}
        self.unknown = min(s for _, s in self.scores.values()) - 10

    def _pattern(self) -> str:
        """Parts of a text between which no piece crosses."""
        pairs = {(a, b) for p in self.scores for a, b in zip(p, p[1:], strict=False)}
        if any(b == MARK != a for a, b in pairs):
            return "(?s).+"
        near: dict[str, set[str]] = {}
        for a, b in pairs:
            if a != MARK:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)

        def reached(todo: set[str]) -> set[str]:
            done: set[str] = set()
            while todo:
                done |= todo
                todo = set().union(*(near.get(c, set()) for c in todo)) - done
            return done

        words = reached({c for p in self.scores for c in p if c.isalpha()})
        signs = reached({chr(c) for c in range(128)} - words)  # shares no piece with the letters
        own = "".join(map(re.escape, sorted(signs)))
        return f"{MARK}*[^{own}{MARK}]+|{MARK}*[{own}]+|{MARK}+"

    def parts(self, text: str) -> list[str]:
        """The text as the model sees it, cut into independent parts."""
        if MARK in text:
            text = text.replace(MARK, _LITERAL)
        return self._parts.findall(MARK + text.replace(" ", MARK)) if text else []

    def _unknown(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in (MARK if c == _LITERAL else c).encode("utf-8", "surrogatepass"))

    def edges(self, part: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each position the pieces that end there: where they start, score and ids."""
        lookup = self._starts.get
        n = len(part)
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            for end in range(start + 1, n + 1):
                found = lookup(part[start:end])
                if found:
                    into[end].append((start, found[1], found[:1]))
                elif end == start + 1:
                    into[end].append((start, self.unknown, self._unknown(part[start])))
                if found is None:
                    break
        return into

    def best(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a part, best first.

        The heuristic is exact, so paths reach a place in the order of their scores: only the first ``n`` to reach it can
        be part of the result, and the agenda holds no more than ``n`` times as many paths as the part has pieces.
        """
        into = self.edges(part)
        forward = [0.0] + [_WORST] * len(part)
        for end in range(1, len(part) + 1):
            forward[end] = max((forward[start] + s for start, s, _ in into[end]), default=_WORST)
        # entries: minus the score of the best path through here, a running number, where, minus the score so far
        agenda: list[tuple[float, int, int, float]] = [(-forward[-1], 0, len(part), 0.0)]
        came: list[tuple[int, tuple[int, ...]]] = [(-1, ())]  # by number: the path that it goes on from, and its first ids
        times = [0] * (len(part) + 1)
        out: list[tuple[float, tuple[int, ...]]] = []
        while agenda and len(out) < n:
            cost, number, at, done = heapq.heappop(agenda)
            if times[at] == n:
                continue
            times[at] += 1
            if not at:
                ids: list[int] = []
                while number >= 0:
                    number, own = came[number]
                    ids += own
                out.append((-cost, tuple(ids)))
                continue
            for start, s, own in into[at]:
                if forward[start] > _WORST and times[start] < n:
                    came.append((number, own))
                    heapq.heappush(agenda, (done - s - forward[start], len(came) - 1, start, done - s))
        return out

    def _hashed(self, codes: np.ndarray) -> np.ndarray:
        """Sums over the characters of each row up to each place; a part's hash follows from two of them."""
        c = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        c ^= c >> np.uint64(29)
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(c * self._power[: codes.shape[1]], axis=1, out=out[:, 1:])
        return out

    def _index(self) -> None:
        """The pieces by their hashes."""
        n = max(map(len, self.scores))
        base = 0xD1342543DE82EF97
        for name, b in (("_power", base), ("_back", pow(base, -1, 2**64))):
            p = np.full(max(n, _LONG) + 1, b, np.uint64)
            p[0] = 1
            setattr(self, name, np.cumprod(p, dtype=np.uint64))
        self.longest = n
        hashes, ids, scores = [], [], []
        for piece, (i, s) in self.scores.items():
            hashes.append(self._hashed(_codes([piece], len(piece)))[0, -1])
            ids.append(i)
            scores.append(s)
        order = np.argsort(np.array(hashes, np.uint64))
        self._hash = np.array(hashes, np.uint64)[order]
        self._id, self._score = np.array(ids, np.int32)[order], np.array(scores, np.float64)[order]
        # two sieves by the first bits of a hash: what can be a piece, and what can be the start of a longer one
        self._sieve, self._more = np.zeros(1 << 22, bool), np.zeros(1 << 22, bool)
        self._sieve[self._hash >> np.uint64(42)] = True
        by_size: dict[int, list[str]] = {}
        for piece in self.scores:
            by_size.setdefault(len(piece), []).append(piece)
        for size, own in by_size.items():
            self._more[(self._hashed(_codes(own, size))[:, 1:-1] >> np.uint64(42)).ravel()] = True

    def _solve(self, parts: Iterable[str]) -> None:
        """Best ids, their score and the loss of the second best, for many parts at once: one forward pass
        over the positions that keeps the best two scores, for all parts of a length together."""
        by_size: dict[int, list[str]] = {}
        for p in parts:
            by_size.setdefault(len(p), []).append(p)
        for n, own in by_size.items():
            if n > _LONG:
                self._remember(own, *zip(*map(self._alone, own), strict=True))
            else:
                for at in range(0, len(own), 20_000):
                    self._solve_group(own[at : at + 20_000], n)

    def _solve_group(self, group: list[str], n: int) -> None:
        size = len(group)
        sums = self._hashed(_codes(group, n))
        first, second = np.full((n + 1, size), _WORST), np.full((n + 1, size), _WORST)
        first[0] = 0.0
        start, piece = np.zeros((n + 1, size), np.int32), np.full((n + 1, size), -1, np.int32)
        for a in range(n):
            alive = np.arange(size)
            for b in range(a + 1, min(n, a + self.longest) + 1):
                h = (sums[alive, b] - sums[alive, a]) * self._back[a]
                bits = h >> np.uint64(42)
                can = np.flatnonzero(self._sieve[bits])
                k = np.searchsorted(self._hash, h[can])
                hit = self._hash[np.minimum(k, len(self._hash) - 1)] == h[can]
                which, k = alive[can[hit]], k[hit]
                s, i = self._score[k], self._id[k]
                if b == a + 1 and len(which) < size:
                    all_s, all_i = np.full(size, float(self.unknown)), np.full(size, -1, np.int32)
                    all_s[which], all_i[which] = s, i
                    which, s, i = alive, all_s, all_i
                if len(which):
                    x, top = first[a, which] + s, first[b, which]
                    better = x > top
                    second[b, which] = np.where(better, np.maximum(top, second[a, which] + s), np.maximum(second[b, which], x))
                    w = which[better]
                    first[b, w], start[b, w], piece[b, w] = x[better], a, i[better]
                alive = alive[self._more[bits]]
                if not len(alive):
                    break
        # all best paths at once, from their ends: a row for each part, in the order of the text, -2 before its first piece
        at, alive, steps = np.full(size, n), np.arange(size), []
        while len(alive):
            row = np.full(size, -2, np.int32)
            row[alive] = piece[at[alive], alive]
            steps.append(row)
            at[alive] = start[at[alive], alive]
            alive = alive[at[alive] > 0]
        paths = np.stack(steps[::-1], axis=1)
        odd = (paths == -1).any(axis=1)
        plain = np.flatnonzero(~odd)
        rows = paths[plain]
        full = rows > -2
        self._remember([group[k] for k in plain.tolist()], (rows[full], full.sum(1)), first[n, plain], (first[n] - second[n])[plain])
        if odd.any():  # with characters in no piece: these become bytes
            ids = []
            for k in np.flatnonzero(odd).tolist():
                own: list[int] = []
                end = n
                while end:
                    begin = start[end, k]
                    own += [int(piece[end, k])] if piece[end, k] >= 0 else reversed(self._unknown(group[k][begin]))
                    end = begin
                ids.append(own[::-1])
            self._remember([group[k] for k in np.flatnonzero(odd).tolist()], ids, first[n, odd], (first[n] - second[n])[odd])

    def _alone(self, part: str) -> tuple[tuple[int, ...], float, float]:
        """The same for one long part."""
        into = self.edges(part)
        n = len(part)
        first, second = [0.0] + [_WORST] * n, [_WORST] * (n + 1)
        back: list[tuple] = [()] * (n + 1)
        for end in range(1, n + 1):
            for start, s, ids in into[end]:
                v = first[start] + s
                if v > first[end]:
                    second[end] = max(first[end], second[start] + s)
                    first[end] = v
                    back[end] = (start, ids)
                elif v > second[end]:
                    second[end] = v
        out: list[int] = []
        end = n
        while end:
            end, ids = back[end]
            out.extend(reversed(ids))
        return tuple(reversed(out)), first[n], first[n] - second[n]

    def _remember(self, parts: list[str], ids: list | tuple[np.ndarray, np.ndarray], scores: Iterable[float], losses: Iterable[float]) -> None:
        """Keep what was found for ``parts``; their ids are lists, or all of them and how many each has."""
        if isinstance(ids, tuple) and isinstance(ids[0], np.ndarray):
            flat, sizes = ids
        else:
            flat, sizes = np.array([*chain.from_iterable(ids)], np.int32), np.array([len(x) for x in ids], np.int64)
        at = len(self._memory)
        self._memory.update(zip(parts, range(at, at + len(parts)), strict=True))
        new = (flat, sizes, np.array(scores, np.float64), np.array(losses, np.float64))
        for own, more in zip(self._found, new, strict=True):
            own.append(more)

    def forget(self) -> None:
        self._searched: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self._memory: dict[str, int] = {}
        self._found: list[list[np.ndarray]] = [[np.empty(0, t)] for t in (np.int32, np.int64, np.float64, np.float64)]

    def encode_all(self, texts: list[str | None]) -> Iterator[Encoded]:
        """The texts encoded, some at a time."""
        some: list[list[str]] = []
        count = 0
        for k, text in enumerate(texts):
            some.append(self.parts(text or ""))
            count += len(some[-1])
            if count >= 250_000 or k == len(texts) - 1:
                yield self._encode_parts(some)
                some, count = [], 0

    def _encode_parts(self, many: list[list[str]]) -> Encoded:
        every = list(chain.from_iterable(many))
        rows = list(map(self._memory.get, every))
        if None in rows:
            new = dict.fromkeys(p for p, r in zip(every, rows, strict=True) if r is None)
            if len(self._memory) + len(new) > self.cache_size:
                self.forget()
                new = dict.fromkeys(every)
            self._solve(new)
            rows = list(map(self._memory.get, every))
        self._found = [[np.concatenate(x)] for x in self._found]
        (flat,), (sizes,), (scores,), (losses,) = self._found
        at = np.array(rows, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum([len(parts) for parts in many])]).astype(np.int64)
        ids, places = _taken(flat, starts[at], sizes[at])
        # sums of whole steps, so that they are exact in any order
        total = np.concatenate([[0.0], np.cumsum(scores[at])])
        own = total[ends[1:]] - total[ends[:-1]]
        others: list[list] = []
        if self.n_best > 1:
            for k, parts in enumerate(many):
                here = slice(ends[k], ends[k + 1])
                others.append(self._others(parts, losses[at[here]], places[here] - places[here][:1], lambda i, a=at[here]: (flat[starts[a[i]] : starts[a[i] + 1]], scores[a[i]]), own[k]))
        return Encoded(ids, places[ends], own, others or [[] for _ in many])

    def encode(self, text: str | None) -> tuple[list[int], float, list]:
        (found,) = self.encode_all([text])
        return found.ids.tolist(), float(found.scores[0]), found.others[0]

    def _options(self, part: str, found: Callable[[], tuple[np.ndarray, float]]) -> list[tuple[float, tuple[int, ...]]]:
        if (own := self._searched.get(part)) is None:
            if len(self._searched) >= 20_000:
                self._searched.clear()
            ids, top = found()
            ids = tuple(ids.tolist())
            own = self._searched[part] = [(float(top), ids), *[o for o in self.best(part, self.n_best) if o[1] != ids][: self.n_best - 1]]
        return own

    def _others(self, parts: list[str], losses: np.ndarray, places: np.ndarray, found: Callable, score: float) -> list[tuple[float, list[tuple[int, int, list[int]]]]]:
        """The next best of a whole text: only the N - 1 parts with the least loss can differ from the best in one of them."""
        n = self.n_best
        loose = sorted(i for i in np.argsort(losses, kind="stable")[: n - 1].tolist() if losses[i] != np.inf)
        options = [self._options(parts[i], lambda i=i: found(i)) for i in loose]
        combos: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for own in options:
            combos = heapq.nsmallest(n, [(loss + own[0][0] - s, (*which, k)) for loss, which in combos for k, (s, _) in enumerate(own)])
        starts = [int(places[i]) for i in loose]
        return [
            (float(score - loss), [(start, len(own[0][1]), list(own[k][1])) for start, own, k in zip(starts, options, which, strict=True) if k])
            for loss, which in combos[1:]
        ]

    def decodes_to(self, found: Encoded, texts: list[str | None]) -> list[bool]:
        """Whether the best ids of each text decode to it."""
        raw, places = _taken(self._bytes, self._byte_at[found.ids], self._byte_at[found.ids + 1] - self._byte_at[found.ids])
        raw, ends = raw.tobytes(), places[found.ends].tolist()
        return [raw[a:b] == (b" " + t.encode("utf-8", "surrogatepass") if t else b"") for a, b, t in zip(ends, ends[1:], texts, strict=False)]

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


def applied(ids: list[int], changes: Iterable[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of an alternative."""
    out, done = [], 0
    for at, n, own in changes:
        out += ids[done:at]
        out += own
        done = at + n
    return out + ids[done:]


def digest_of(ids: np.ndarray, others: Iterable[tuple[float, Iterable[tuple[int, int, list[int]]]]]) -> str:
    """SHA-256 over the ids of all alternatives: of each how many, then the ids, as four bytes with the lowest first."""
    out, best = hashlib.sha256(), memoryview(ids.astype("<i4").tobytes())
    for _, changes in others:
        size, done, parts = len(ids), 0, []
        for at, n, own in changes:
            parts += [best[4 * done : 4 * at], np.array(own, "<i4").tobytes()]
            size += len(own) - n
            done = at + n
        out.update(size.to_bytes(4, "little"))
        for part in (*parts, best[4 * done :]):
            out.update(part)
    return out.hexdigest()


_CHANGE = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
_OTHER = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("changes", T.ArrayType(_CHANGE))])


def _taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of an array one after the other, and where each begins, with the end of the last."""
    places = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(starts - places[:-1], sizes) + np.arange(places[-1])], places


@lru_cache(4)
def _model(name: str, n_best: int) -> PieceModel:
    with open(SparkFiles.get(name), "rb") as f:
        return PieceModel(f.read(), n_best)


def _shipped(df: DataFrame, model_path: str) -> str:
    """Send the model file to the executors; its name there."""
    df.sparkSession.sparkContext.addFile(model_path)
    return os.path.basename(model_path)


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", n_best: int = 4, round_trip: bool = False, digest: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``, ``score`` and ``others`` (the N - 1 next best, as changes of ``ids``); with ``round_trip``
    also whether decoding gives the text back, with ``digest`` also ``others_sha256``, a digest of the ids of the others."""
    name = _shipped(docs, model_path)
    fields = [("ids", T.ArrayType(T.IntegerType())), ("score", T.DoubleType()), ("others", T.ArrayType(_OTHER)), *([("round_trip", T.BooleanType())] if round_trip else []), *([("others_sha256", T.StringType())] if digest else [])]

    def make() -> Callable:
        model = _model(name, n_best)

        def f(columns: list[list]) -> list:
            texts, at = columns[0], 0
            ids, sizes, scores, others, same, digests = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], [np.empty(0)], [], [], []
            for some in model.encode_all(texts):
                ids.append(some.ids)
                sizes.append(np.diff(some.ends))
                scores.append(some.scores)
                others += [[{"score": s, "changes": [{"at": a, "n": n, "ids": i} for a, n, i in ch]} for s, ch in own] for own in some.others]
                if round_trip:
                    same += model.decodes_to(some, texts[at : at + len(some.scores)])
                if digest:
                    digests += [digest_of(some.ids[a:b], o) for a, b, o in zip(some.ends, some.ends[1:], some.others, strict=False)]
                at += len(some.scores)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            return [lists, np.concatenate(scores), others, *([same] if round_trip else []), *([digests] if digest else [])]

        f.done = model.forget  # the worker may have other things to do after this task
        return f

    return with_columns_from(docs, fields, [text_col], make, drop=() if keep_text else [text_col])


def decode(docs: DataFrame, model_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for; null ids give a null."""
    name = _shipped(docs, model_path)

    def make() -> Callable:
        model = _model(name, 1)
        return lambda columns: [[None if ids is None else model.decode(ids) for ids in columns[0]]]

    return with_columns_from(docs, [(out_col, T.StringType())], [ids_col], make)
