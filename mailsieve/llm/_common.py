"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the session names in ``spark.checkpoint.dir``.  Only a local
    session may do without that setting, and then gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("mailsieve.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="mailsieve-")
        spark.conf.set("mailsieve.checkpoint.dir", base)
    return base.rstrip("/")


#: Spark deletes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the
    lineage, survives the loss of executors, and gives the planner true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._mailsieve_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in frames:
        path = df._mailsieve_path
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def without(df: DataFrame, ids: DataFrame, id_col: str, max_broadcast: int = 1_000_000) -> DataFrame:
    """``df`` without the rows whose id is in ``ids`` (one long column, written): they are broadcast if they
    are at most ``max_broadcast``, and otherwise joined."""
    small = ids.limit(max_broadcast + 1).count() <= max_broadcast
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), id_col, "left_anti").select(*df.columns)


def with_columns_from(
    df: DataFrame,
    fields: Iterable[tuple[str, T.DataType]],
    reads: list[str],
    make: Callable[[], Callable[[list[list]], list[list]]],
    drop: Iterable[str] = (),
) -> DataFrame:
    """Add columns computed in Python from the columns ``reads``, a slice of rows at a time.

    ``make`` runs once per task and returns a function from the lists of values
    of ``reads`` to the lists of values of ``fields``; its ``done``, if it has one,
    is called at the end.  Other columns pass
    through untouched.  A column of the input that has the name of a new one is
    replaced, those in ``drop`` are left out.
    """
    fields = list(fields)
    new = {n for n, _ in fields}
    gone = set(drop)
    keep = [f for f in df.schema.fields if f.name not in new and f.name not in gone]
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t in fields)])
    arrow = {n: _arrow_type(t) for n, t in fields}
    names = [f.name for f in keep]
    inputs = [*dict.fromkeys([*names, *reads])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        try:
            for batch in batches:
                for part in slices(batch):
                    got = f([_values(part.column(c)) for c in reads])
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(n) for n in names), *(v if isinstance(v, pa.Array) else pa.array(v, arrow[n]) for (n, _), v in zip(fields, got, strict=True))],
                        names=[*names, *arrow],
                    )
        finally:
            getattr(f, "done", lambda: None)()

    return df.select(*(f"`{c}`" for c in inputs)).mapInArrow(returned(run), schema)


def returned(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which Spark keeps for later tasks, gives the memory it no longer uses back."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            given_back()

    return f


def given_back() -> None:
    """Give the memory that this process no longer uses back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _values(column: pa.Array) -> list:
    if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type) and not column.null_count:
        flat = column.flatten()  # much faster than to_pylist for long lists
        if not flat.null_count:
            numbers, ends = flat.to_numpy().tolist(), (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
            return [numbers[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return column.to_pylist()


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def ascii_lower(text: str) -> str:
    """``text`` with A-Z, and nothing else, in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
