"""Line dedup across documents.

Each text is split at line feeds and every line gets a key: stripped of ASCII
white space and lower-cased (A-Z).  Only 128-bit hashes of the keys and the
ids travel: they are counted over distinct documents, the keys found in too
many documents are joined back to the documents that hold them, and the lines
are dropped where the text is put together again by position.

One line may be in a third of all documents: the counts are summed before the
shuffle, and the join back to the holders is one whose large partitions Spark
splits.  A document's own list of dropped keys is bounded by its lines.

Defined cases: a null or empty text is one empty line and stays what it is;
equal lines of one document go or stay together; rows with the same id are one
document when counting and each lose the same lines; a null id is one document
with the smallest id; columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import returned, slices, with_columns_from, written

_STRIP = b" \t\n\r\x0b\x0c"
_NO_ID = -(2**63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, None if the key is too short."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    schema = "k binary, doc long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys: list[bytes] = []
                ids: list[int] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text:
                        found = {line_key(x, min_chars) for x in text.encode("utf-8", "surrogatepass").split(b"\n")}
                        found.discard(None)
                        keys += found
                        ids += [doc] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["k", "doc"])

    return docs.select(F.coalesce(F.col(id_col), F.lit(_NO_ID)).alias("doc"), F.col(text_col)).mapInArrow(returned(run), schema)


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """``docs`` with the text cleaned, ``n_lines`` (before) and ``n_dropped``.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents
    lose their lines in all of them but the one with the largest id.
    """
    held = written(_keys(docs, id_col, text_col, min_chars), "line-keys")
    common = written(
        held.groupBy("k").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs).select("k", "last"),
        "line-common",
    )
    gone = held.join(common, "k").where(F.col("doc") != F.col("last")).groupBy("doc").agg(F.collect_set("k").alias("__keys")).withColumnRenamed("doc", "__doc")
    gone = written(gone, "line-gone")
    joined = docs.join(gone.hint("shuffle_hash"), F.coalesce(F.col(id_col), F.lit(_NO_ID)) == F.col("__doc"), "left").drop("__doc")

    def make() -> Callable:
        def f(columns: list[list]) -> list[list]:
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(*columns, strict=True):
                n, dropped = (text.count("\n") + 1 if text else 1), 0
                if keys:
                    keys = {bytes(k) for k in keys}
                    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                    kept = [x for x in lines if line_key(x, min_chars) not in keys]
                    dropped = len(lines) - len(kept)
                    text = b"\n".join(kept).decode("utf-8", "surrogatepass")
                texts.append(text)
                n_lines.append(n)
                n_dropped.append(dropped)
            return [texts, n_lines, n_dropped]

        return f

    out = with_columns_from(joined, [("__text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())], [text_col, "__keys"], make, drop=[text_col, "__keys"])
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*(F.col("__text").alias(c) if c == text_col else F.col(c) for c in rest), "n_lines", "n_dropped")
