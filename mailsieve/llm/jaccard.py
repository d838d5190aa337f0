"""Near duplicates by the Jaccard similarity of word shingles: an exact join.

The distinct n-grams of a text are its set.  Two sets that are similar enough
have most of their n-grams in common, so a set of which too few n-grams occur in
any other text has no partner.  What remains is compared by vertical
partitioning: the n-grams have one global order (rare ones first, by powers of
two of how often they occur, then by hash), the order is cut into fragments, the
overlap of a candidate pair is counted in each fragment separately, and the
counts are summed per pair.

1. ``_tallied``: the texts are read in chunks.  A chunk sends each of its distinct
   n-grams once, with its count, to the bucket of its hash; the bucket sends back
   those that occur elsewhere too.  So an n-gram in a third of all texts is a row
   per chunk and not per text.
2. Equal sets are one class; copies are never compared.
3. Classes meet at the n-grams of their prefixes (the first of the global order; two
   similar sets share one of them).  Where they meet, each is compared only with the
   one of its size that has the fewest n-grams of its own; these, one for each size
   and each salt of a frequent n-gram, are compared with the next one.  That takes as
   many comparisons as there are rows, and most links are of this kind.
4. What the links found leave apart although it meets is compared by groups: the
   classes that meet a component without a link to it (few, as a rule) with its
   members and with each other, block by block.  Only counts of n-grams per
   slot of the hash are compared there, which bound the overlap from above; the pairs
   that pass are counted exactly.  No link between different components is lost.

N-grams are 56-bit hashes, sets 96-bit ones.

Defined cases: a null or wordless text has an empty set and is linked with
nothing; fewer words than ``n`` make one n-gram; rows with the same id are one
node, so their links are joined; a null id is one node, larger than any other;
columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, returned, slices, written
from .graph import components

_LAST_ID = 2**63 - 1
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bits of an n-gram; the bits above them in a long hold its place by frequency.
_BITS = 56
_GRAM = (1 << _BITS) - 1
#: Stands for the owner of an n-gram that several texts of a chunk have.
_MANY = 65_535


class WordHasher:
    """64-bit hashes of the words of a text: sums of a random number per byte times powers of an odd base.

    Sums of a whole block are taken at once; a word's is the difference of two,
    times the inverse power of where it starts.
    """

    def __init__(self) -> None:
        self.bytes = np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, 256, np.uint64)
        self._room(_BLOCK)

    def _room(self, n: int) -> None:
        base = 0xD1342543DE82EF97
        powers = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            powers.append(np.cumprod(p, dtype=np.uint64))
        self.power, self.back = powers

    def words(self, raw: bytes) -> np.ndarray:
        if len(raw) <= _BLOCK:
            return self._block(raw)
        out, at = [], 0
        while at < len(raw):
            end = min(at + _BLOCK, len(raw))
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
            out.append(self._block(raw[at:end]))
            at = end
        return np.concatenate(out)

    def _block(self, raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw, np.uint8)
        inside = np.concatenate([[False], ~_SPACE[b], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        if len(b) > len(self.power):
            self._room(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.bytes[b] * self.power[: len(b)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.back[start]
        h ^= h >> np.uint64(31)
        h *= _M[2]
        return h ^ (h >> np.uint64(30))


def shingles(text: str | None, n: int, words: WordHasher) -> np.ndarray:
    """The set of a text: sorted distinct hashes of ``_BITS`` bits."""
    h = words.words(text.encode("utf-8", "surrogatepass").lower()) if text else np.empty(0, np.uint64)
    size = len(h)
    if not size:
        return h
    k = min(n, size)
    out = np.full(size - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + size - k + 1]) * _M[0]
        out ^= out >> np.uint64(32)
    out *= _M[1]
    out ^= out >> np.uint64(29)
    return np.unique(out >> np.uint64(64 - _BITS))


def _id(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=12).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _table(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=[*columns])


def _packed(grams: np.ndarray) -> bytes:
    """Seven bytes each."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8").astype(np.uint64)


#: ``chunk``, ``bucket`` and ``head``, then binaries: of the head all about the texts of the chunk, else of n-grams.
_PARTS = "chunk long, bucket int, head boolean, grams binary, owners binary, counts binary"


def _part(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] if rows else [()] * 6
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["chunk", "bucket", "head", "grams", "owners", "counts"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of one value of ``key`` at a time; equal ones follow each other."""
    group: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if group and row[key] != group[0][key]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _dealt(docs: DataFrame, n: int, buckets: int, chunk_grams: int) -> DataFrame:
    """From ``doc`` and ``text`` to the distinct n-grams of each chunk by bucket, and a head for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher()
        place = TaskContext.get().partitionId() << 24
        ids: list[int] = []
        sets: list[np.ndarray] = []
        total = made = 0

        def chunk() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in sets], np.int64)
            grams = np.concatenate(sets)
            order = np.argsort(grams, kind="stable")
            owners = np.repeat(np.arange(len(sets)), sizes).astype(np.uint16)[order]
            grams = grams[order]
            starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
            counts = np.diff(starts, append=len(grams))
            distinct, several = grams[starts], counts > 1
            place_of = np.repeat(np.cumsum(several) - 1, counts)
            inside = np.repeat(several, counts)
            classes = np.array([_id(s) for s in sets], np.int64).reshape(-1, 2)
            about = np.concatenate([np.array(ids, np.int64), sizes, classes[:, 0], classes[:, 1]]).astype("<i8").tobytes()
            now = place + made
            yield _part([(now, now % buckets, True, about, owners[inside].tobytes(), place_of[inside].astype(np.uint32).tobytes())])
            owner = np.where(several, np.uint16(_MANY), owners[starts])
            edges = np.searchsorted(distinct, _edges(buckets))
            for first in range(0, buckets, 64):
                rows = []
                for k in range(first, min(first + 64, buckets)):
                    a, b = edges[k], edges[k + 1]
                    if a < b:
                        rows.append((now, k, False, _packed(distinct[a:b]), owner[a:b].tobytes(), counts[a:b][several[a:b]].astype(np.uint32).tobytes()))
                if rows:
                    yield _part(rows)

        for batch in batches:
            for part in slices(batch, 500):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingles(text, n, words)
                    ids.append(doc)
                    sets.append(s)
                    total += len(s)
                    if total >= chunk_grams or len(sets) == _MANY:
                        yield from chunk()
                        ids, sets, total, made = [], [], 0, made + 1
        if sets:
            yield from chunk()

    return docs.mapInArrow(returned(run), _PARTS)


def _edges(buckets: int) -> np.ndarray:
    return np.array([k * (_GRAM + 1) // buckets for k in range(buckets + 1)], np.uint64)


def _shared(dealt: DataFrame) -> DataFrame:
    """Of the n-grams in each bucket those that more than one text has, for the chunk they came from, with how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "bucket"):
            heads = [(r["chunk"], r["bucket"], True, r["grams"], r["owners"], r["counts"]) for r in rows if r["head"]]
            if heads:
                yield _part(heads)
            rows = [r for r in rows if not r["head"]]
            if not rows:
                continue
            grams = [_unpacked(r["grams"]) for r in rows]
            owners = [np.frombuffer(r["owners"], np.uint16) for r in rows]
            times = []
            for r, o in zip(rows, owners, strict=True):
                t = np.ones(len(o), np.int64)
                t[o == _MANY] = np.frombuffer(r["counts"], np.uint32)
                times.append(t)
            every = np.concatenate(grams)
            order = np.argsort(every, kind="stable")
            every = every[order]
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            found = np.empty(len(every), np.int64)
            found[order] = np.repeat(np.add.reduceat(np.concatenate(times)[order], starts), np.diff(starts, append=len(every)))
            out, at = [], 0
            for r, g, o in zip(rows, grams, owners, strict=True):
                own = found[at : at + len(g)]
                at += len(g)
                if (m := own > 1).any():
                    out.append((r["chunk"], r["bucket"], False, _packed(g[m]), o[m].tobytes(), np.minimum(own[m], 2**32 - 1).astype(np.uint32).tobytes()))
            if out:
                yield _part(out)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(returned(run), _PARTS)


def _gathered(shared: DataFrame, t: Fraction) -> DataFrame:
    """A row for each text: ``doc``, ``node`` (a number of its own), ``size`` and ``c1``, ``c2`` of its set, and the n-grams
    it shares in their global order if they are enough for a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "chunk"):
            head = next(r for r in rows if r["head"])
            doc, size, c1, c2 = np.frombuffer(head["grams"], "<i8").reshape(4, -1)
            rows = sorted((r for r in rows if not r["head"]), key=lambda r: r["bucket"])
            grams = np.concatenate([np.empty(0, np.uint64), *(_unpacked(r["grams"]) for r in rows)])
            owners = np.concatenate([np.empty(0, np.uint16), *(np.frombuffer(r["owners"], np.uint16) for r in rows)])
            counts = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(r["counts"], np.uint32) for r in rows)])
            # frequency first: so many bits has the count
            keys = (np.ceil(np.log2(counts)).astype(np.uint64) << np.uint64(_BITS)) | grams
            several = owners == _MANY
            again, whose = np.frombuffer(head["counts"], np.uint32), np.frombuffer(head["owners"], np.uint16)
            keys, owners = np.concatenate([keys[~several], keys[several][again]]), np.concatenate([owners[~several], whose])
            found = np.bincount(owners, minlength=len(doc))
            likely = (found * t.denominator >= size * t.numerator) & (size > 0)
            m = likely[owners]
            keys, owners = keys[m], owners[m]
            order = np.lexsort((keys, owners))
            keys = keys[order].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(likely, found, 0))])
            node = (rows[0]["chunk"] if rows else head["chunk"]) * 65_536 + np.arange(len(doc))
            for a in range(0, len(doc), 2000):
                b = min(a + 2000, len(doc))
                lists = pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), pa.array(keys[ends[a] : ends[b]], pa.int64()), mask=pa.array(~likely[a:b]))
                yield pa.RecordBatch.from_arrays([*(pa.array(c[a:b], pa.int64()) for c in (doc, node, size, c1, c2)), lists], names=["doc", "node", "size", "c1", "c2", "grams"])

    return shared.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(returned(run), "doc long, node long, size long, c1 long, c2 long, grams array<long>")


def _tallied(docs: DataFrame, n: int, t: Fraction, bucket_grams: int, chunk_grams: int) -> DataFrame:
    # a word and a space have four bytes or more, as a rule: about as many n-grams
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(512, chars // 4 // bucket_grams)
    return _gathered(_shared(_dealt(docs, n, buckets, chunk_grams)), t)


def _overlap(a: str | Column, b: str | Column, t: Fraction) -> Column:
    """How many n-grams two sets have in common at least, if they are similar enough, times the sum of the parts of ``t``."""
    return (F.col(a) if isinstance(a, str) else a) * t.numerator + (F.col(b) if isinstance(b, str) else b) * t.numerator


def _fits(t: Fraction) -> Column:
    """Two classes (``na``, ``nb`` n-grams, of which they share ``sa``, ``sb`` with anyone) can be similar enough."""
    sizes = F.least("na", "nb") * t.denominator >= F.greatest("na", "nb") * t.numerator
    return sizes & (F.least("sa", "sb") * (t.numerator + t.denominator) >= _overlap("na", "nb", t))


def _posts(sets: DataFrame, t: Fraction, salt_at: int = 256) -> DataFrame:
    """The n-grams of the prefixes: ``g``, ``salt`` (one of as many as the n-gram is frequent), class and sizes.

    The n-grams that a set shares with none come first in the order, so that the prefix has fewer of the others.
    """
    first = F.col("size") - F.ceil(F.col("size") * t.numerator / F.lit(t.denominator)) + 1
    left = F.greatest(F.lit(0), first - (F.col("size") - F.col("shared"))).cast("int")
    rows = sets.select("cid", "size", "shared", F.explode(F.slice("grams", F.lit(1), left)).alias("g"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cid"), _salts("g", salt_at)))


def _salts(g: str, salt_at: int = 256) -> Column:
    return F.expr(f"greatest(1L, shiftleft(1L, cast(shiftright({g}, {_BITS}) as int)) div {salt_at}L)")


def _linked(pairs: DataFrame, sets: DataFrame, t: Fraction, pivots: list[int]) -> DataFrame:
    """The pairs of classes (``a``, ``b``) that are similar enough, as ``u`` and ``v``.

    A class that very many are compared with is dealt to as many parts as there are partitions.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    between = lambda lo, hi: F.filter("grams", lambda g: (g >= F.lit(lo)) & (g < F.lit(hi)))
    cut = [between(lo, hi) for lo, hi in zip([0, *pivots], [*pivots, 2**63 - 1], strict=True)]
    frags = sets.select("cid", "size", F.posexplode(F.array(*cut)).alias("frag", "grams")).where(F.size("grams") > 0)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts)))
    left = dealt.join(frags.withColumnsRenamed({"cid": "a", "size": "na", "grams": "ga"}), "a")
    right = dealt.select("b", "part").distinct().join(frags.withColumnsRenamed({"cid": "b", "size": "nb", "grams": "gb"}), "b")
    partial = left.join(right, ["b", "part", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("c"))
    same = partial.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return same.where(F.col("c") * (t.numerator + t.denominator) >= _overlap("na", "nb", t)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _pivots(sets: DataFrame, cuts: int) -> list[int]:
    """Where to cut the global order so that the fragments hold about as many n-grams each: at one of 64 places per power of two."""
    steps = sets.select(F.explode("grams").alias("g")).groupBy(F.shiftright("g", _BITS - 6).alias("at")).agg(F.count("*").alias("n")).orderBy("at").collect()
    total, seen, out = sum(r.n for r in steps), 0, []
    for r in steps:
        seen += r.n
        if len(out) < cuts - 1 and seen * cuts >= total * (len(out) + 1):
            out.append((r["at"] + 1) << (_BITS - 6))
    return out


def _met(sets: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of classes that meet: each with the one of its size and salt that has the fewest n-grams of its own, and
    these with the next one."""
    posts = _posts(sets, t).withColumn("step", F.floor(F.log("size") / F.log(F.lit(float(1 / t)))).cast("int") if t < 1 else F.col("size"))
    # fewest own n-grams first, then the smaller set, then the id: compared as three numbers
    best = F.min(F.struct((F.col("size") - F.col("shared")).alias("own"), "size", "cid", "shared"))
    near = posts.withColumn("hub", best.over(Window.partitionBy("g", "salt", "step")))
    stars = near.where("cid <> hub.cid").select(F.col("cid").alias("a"), F.col("size").alias("na"), F.col("shared").alias("sa"), "hub")
    before = F.lag("hub").over(Window.partitionBy("g").orderBy("step", "hub"))
    chain = near.where("cid = hub.cid").select("g", "step", "hub").withColumn("last", before).where("last is not null and last.cid <> hub.cid")
    chain = chain.select(F.col("last.cid").alias("a"), F.col("last.size").alias("na"), F.col("last.shared").alias("sa"), "hub")
    both = stars.union(chain).select("a", "na", "sa", F.col("hub.cid").alias("b"), F.col("hub.size").alias("nb"), F.col("hub.shared").alias("sb"))
    return both.where(_fits(t)).select("a", "b").distinct()


#: Slots of the hash that n-grams are counted in: about half as many as the set has n-grams, a power of two.
_SLOTS = (4, 13)


def _counted(keys: np.ndarray, size: int) -> np.ndarray:
    bits = min(max(int(size - 1).bit_length() - 1, _SLOTS[0]), _SLOTS[1])
    return np.bincount((keys & _GRAM) >> (_BITS - bits), minlength=1 << bits).astype("<u2")


def _counters(members: DataFrame) -> DataFrame:
    """``members`` with the counts of their n-grams by slot instead of the n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500):
                own = [_counted(np.array(k, np.int64), s).tobytes() for k, s in zip(part.column("grams").to_pylist(), part.column("size").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(own, pa.binary())], names=[*part.schema.names[:-1], "slots"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields[:-1])
    return members.mapInArrow(returned(run), f"{fields}, slots binary")


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    return x.reshape(len(x), width, -1).sum(2, dtype=np.int32)


def _compare(t: Fraction) -> Callable[[pa.Table], pa.Table]:
    """The pairs of two blocks, of different components, that their counts by slot allow to be similar enough."""
    whole = t.numerator + t.denominator

    def run(table: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            own = table.filter(pa.compute.equal(table["side"], side))
            slots: dict[int, list[int]] = {}
            raw = own["slots"].to_pylist()
            for i, s in enumerate(raw):
                slots.setdefault(len(s) // 2, []).append(i)
            numbers = [own[c].to_numpy() for c in ("cid", "root", "size", "shared")]
            less = np.array(own["minor"].to_pylist(), bool)
            sides.append([(w, *(c[at] for c in numbers), less[at], np.frombuffer(b"".join(raw[i] for i in at), "<u2").reshape(-1, w).astype(np.int32)) for w, at in slots.items()])
        alone = not sides[1]
        a_out, b_out = [], []
        for i, (wa, ca, ra, na, sa, la, xa) in enumerate(sides[0]):
            for j, (wb, cb, rb, nb, sb, lb, xb) in enumerate(sides[0] if alone else sides[1]):
                if alone and j < i:
                    continue
                width = min(wa, wb)
                fa, fb = _folded(xa, width), _folded(xb, width)
                for lo in range(0, len(ca), 256):
                    row = slice(lo, lo + 256)
                    size = na[row, None] + nb[None]
                    can = (ra[row, None] != rb[None]) & (la[row, None] | lb[None])
                    can &= np.minimum(na[row, None], nb[None]) * t.denominator >= np.maximum(na[row, None], nb[None]) * t.numerator
                    can &= np.minimum(sa[row, None], sb[None]) * whole >= size * t.numerator
                    if alone and i == j:
                        can &= ca[row, None] < cb[None]
                    x, y = np.nonzero(can)
                    for at in range(0, len(x), max(1, (1 << 23) // width)):
                        p, q = x[at : at + max(1, (1 << 23) // width)], y[at : at + max(1, (1 << 23) // width)]
                        most = np.minimum(fa[lo + p], fb[q]).sum(1)
                        m = most * whole >= size[p, q] * t.numerator
                        a_out.append(ca[lo + p[m]])
                        b_out.append(cb[q[m]])
        empty = [np.empty(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(a_out or empty), pa.int64()), "b": pa.array(np.concatenate(b_out or empty), pa.int64())})

    return run


def _apart(sets: DataFrame, roots: DataFrame, t: Fraction, block: int, max_broadcast: int = 1_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of classes of different components that meet at an n-gram and may be similar enough, and the tables made for it.

    At an n-gram the component with the smallest root is the one that the others meet; they are its minors.
    """
    own = sets.join(roots.select(F.col("id").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = written(own.select("cid", "root", "size", "shared", "grams"), "jaccard-rooted")
    posts = _posts(rooted.drop("root"), t).join(rooted.select("cid", "root"), "cid")
    crossed = posts.groupBy("g").agg(F.min("root").alias("of"), F.max("root").alias("most")).where("of < most")
    crossed = crossed.select("g", "of", F.explode(F.sequence(F.lit(0).cast("long"), _salts("g") - 1)).alias("salt"))
    minors = posts.join(crossed, ["g", "salt"]).where("root <> of").select("of", "cid").distinct()
    minors = written(minors, "jaccard-minors")
    ofs = minors.select("of").distinct()
    members = rooted.select("cid", F.col("root").alias("of")).join(ofs, "of").select("of", "cid", F.lit(False).alias("minor"))
    both = minors.select("of", "cid", F.lit(True).alias("minor")).union(members)
    grouped = both.join(rooted, "cid").select("of", "minor", "cid", "root", "size", "shared", "grams")
    step = F.floor(F.log("size") / F.log(F.lit(float(1 / t)))).cast("int") if t < 1 else F.col("size").cast("int")
    grouped = written(_counters(grouped).withColumn("step", step), "jaccard-groups")
    # groups of one step and kind in blocks; only those of more than one block need a number of blocks
    key = ["of", "step", "minor"]
    most = F.greatest(F.lit(64), F.least(F.lit(block), F.floor(F.lit(block * 128) / F.max("size")).cast("int")))
    sizes = grouped.groupBy(*key).agg(F.ceil(F.count("*") / most).alias("blocks")).where("blocks > 1")
    sizes = written(sizes, "jaccard-sizes")
    small = sizes.limit(max_broadcast + 1).count() <= max_broadcast
    dealt = grouped.join(F.broadcast(sizes) if small else sizes.hint("shuffle_hash"), key, "left")
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1)))).drop("blocks")
    blocks = dealt.groupBy(*key, "b").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("shared").alias("most"))
    blocks = written(blocks, "jaccard-blocks")
    x = blocks.withColumnsRenamed({c: f"{c}1" for c in blocks.columns if c != "of"})
    y = blocks.withColumnsRenamed({c: f"{c}2" for c in blocks.columns if c != "of"})
    order = F.struct("step1", "minor1", "b1") <= F.struct("step2", "minor2", "b2")
    sized = (F.col("high1") * t.denominator >= F.col("low2") * t.numerator) & (F.col("high2") * t.denominator >= F.col("low1") * t.numerator)
    enough = F.least("most1", "most2") * (t.numerator + t.denominator) >= _overlap("low1", "low2", t)
    meet = x.join(y, "of").where(order & (F.col("minor1") | F.col("minor2")) & sized & enough)
    meet = written(meet.select("of", "step1", "minor1", "b1", "step2", "minor2", "b2"), "jaccard-meet")
    unit = ["of", "step1", "minor1", "b1", "step2", "minor2", "b2"]
    sides = []
    for k in (1, 2):
        own = meet if k == 1 else meet.where("step1 <> step2 or minor1 <> minor2 or b1 <> b2")
        side = dealt.withColumnsRenamed({"step": f"step{k}", "minor": f"minor{k}", "b": f"b{k}"})
        side = own.join(side, ["of", f"step{k}", f"minor{k}", f"b{k}"])
        sides.append(side.select(*unit, F.lit(k - 1).alias("side"), F.col(f"minor{k}").alias("minor"), "cid", "root", "size", "shared", "slots"))
    found = sides[0].union(sides[1]).groupBy(*unit).applyInArrow(_compare(t), "a long, b long").distinct()
    return written(found, "jaccard-apart"), [rooted, minors, grouped, sizes, blocks, meet]


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    similarity: float | Fraction = Fraction(3, 4),
    cuts: int = 4,
    bucket_grams: int = 2_000_000,
    chunk_grams: int = 1_000_000,
    block: int = 256,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    ``bucket_grams`` and ``chunk_grams`` bound the memory of a task (about 60 bytes an n-gram), ``block`` the members of a
    group that are compared at once.  None of them, nor ``cuts``, changes the result.
    """
    t = Fraction(similarity).limit_denominator(10_000)
    own = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST_ID)).cast("long").alias("doc"), F.col(text_col).alias("text"))
    facts = written(_tallied(own, n, t, bucket_grams, chunk_grams), "jaccard-facts")
    rows = facts.where("size > 0")
    classes = written(rows.groupBy("c1", "c2").agg(F.min("node").alias("cid"), F.min("doc").alias("low"), F.count("*").alias("copies")), "jaccard-classes")

    likely = facts.where("grams is not null")
    kept = likely.groupBy("c1", "c2").agg(F.min("node").alias("node")).select("node")
    sets = likely.join(kept, "node").select(F.col("node").alias("cid"), "size", F.size("grams").cast("long").alias("shared"), "grams")
    sets = written(sets, "jaccard-sets")
    pivots = _pivots(sets, cuts)
    links = written(_linked(_met(sets, t), sets, t, pivots).union(_twice(rows, classes)), "jaccard-links")
    roots = written(components(links), "jaccard-roots")
    dropped(links)
    rest, made = _apart(sets, roots, t, block)
    links = written(_linked(rest, sets, t, pivots).union(roots.select("id", "root")), "jaccard-links")
    dropped(sets, rest, *made)
    found = written(components(links), "jaccard-found")
    dropped(links, roots)

    # the smallest id of a component, for every class that has more than one row or link
    label = classes.join(found, classes.cid == found.id, "left").select("c1", "c2", "low", "copies", F.coalesce("root", "cid").alias("root"))
    lowest = label.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("n"))
    label = label.join(lowest, "root").where("n > 1 or copies > 1").select("c1", "c2", "copies", "component")
    label = written(label, "jaccard-labels")
    dropped(classes, found)
    # classes of more than a ten-thousandth of all rows, at most 10,000, are broadcast: their rows would meet in one task
    many = facts.count() / 10_000
    hot, others = (label.where(F.col("copies") > F.lit(many)), label.where(F.col("copies") <= F.lit(many)))
    out = facts.select("doc", "size", "c1", "c2")
    by_hot = out.join(F.broadcast(hot), ["c1", "c2"])
    by_key = out.join(F.broadcast(hot), ["c1", "c2"], "left_anti").join(others, ["c1", "c2"], "left")
    out = by_hot.unionByName(by_key).select("doc", F.col("size").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))
    null = lambda c: F.when(F.col(c) != _LAST_ID, F.col(c))
    return out.select(null("doc").alias(id_col), "n_shingles", null("component").alias("component_id"))


def _twice(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links that make the rows of one id one node where their sets differ."""
    again = rows.groupBy("doc").agg(F.min("c1").alias("x1"), F.max("c1").alias("y1"), F.min("c2").alias("x2"), F.max("c2").alias("y2"))
    again = again.where("x1 < y1 or x2 < y2").select("doc")
    named = rows.join(again, "doc").join(classes, ["c1", "c2"]).select("doc", "cid").distinct()
    first = named.groupBy("doc").agg(F.min("cid").alias("v"))
    return named.join(first, "doc").where("cid <> v").select(F.col("cid").alias("u"), "v")
