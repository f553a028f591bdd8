"""What the operators share: scratch tables in the shared folder, bounded broadcasts, seeded numbers."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.sources.store import Files, shared_dir

#: A table may be broadcast only if its counted rows times their width stay below this.
BROADCAST_BYTES = 8 << 20

#: One token of the size contract: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing before it.

    The table goes at the end of the ``scratch`` that is open, if one is, else with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weirflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    Files(spark).delete_on_exit(path)
    if (tables := _scratch.get()) is not None:
        tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Where the tables that were materialized lie.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Tables made within the innermost open ``scratch`` of this thread.
_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are materialized within go at the end, except what is materialized by the function that this gives.

    Results that outlive it must not read the others. Who writes an operator's result within it frees all that the operator
    wrote on its way. Each thread has its own, so queries may run side by side.
    """
    outer, own, kept = _scratch.get(), [], []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept.append(own.pop())
        return out

    token = _scratch.set(own)
    try:
        yield keep
    finally:
        _scratch.reset(token)
        for path in own:
            Files(spark).delete(path)
        if outer is not None:
            outer += kept


def drop(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more; any other DataFrame is left alone."""
    if (path := _paths.pop(df, None)) is not None:
        Files(df.sparkSession).delete(path)


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` (a count already made) of ``row_bytes`` fit the bound; else unchanged, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bound the bytes of a batch on its way to a Python worker, where the session doesn't: Spark's own bound is in rows.

    A setting of the session, so it is for the program that owns it (the registered queries, the pipeline); operators never
    change one.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, most)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application: they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="weirflow-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")


_shipped: set[str] = set()
#: What modules want emptied at the end of a task.
AFTER_TASK: list[Callable[[], None]] = []


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, that gives free memory back to the system at the end of the task.

    Python workers live on between tasks; what their allocators keep would count against the executor's memory.
    """

    def wrapped(batches: Iterator) -> Iterator:
        from weirflow.llm import common  # this function is sent by value; the worker's own module has what is to be emptied

        yield from run(batches)
        for clear in common.AFTER_TASK:
            clear()
        gc.collect()
        common.trim()

    return wrapped


def trim() -> None:
    """Give the memory that allocators keep, but nothing uses, back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hash_below(share: float, *parts: Column) -> Column:
    """True for about ``share`` of the values: their 64-bit hash is below that share of its range, however small."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*parts) < F.lit(int(share * float(1 << 63)) * 2 - (1 << 63))


def quoted(name: str) -> str:
    """A column's name for expressions and schemas, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator of which the rows go through Python workers, for columns of any name: Spark hands columns over by names that
    it reads as expressions, so those with dots or backticks have others meanwhile."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *given, **named) -> DataFrame:
        odd = {c: f"odd column {i}" for i, c in enumerate(docs.columns) if "`" in c or "." in c}
        if not odd:
            return operator(docs, *given, **named)
        out = operator(docs.select(*[F.col(quoted(c)).alias(odd.get(c, c)) for c in docs.columns]), *given, **named)
        back = {n: c for c, n in odd.items()}
        return out.select(*[F.col(quoted(c)).alias(back.get(c, c)) for c in out.columns])

    return run


def sealed(c: Column) -> Column:
    """A key that equals itself when null, for joins and groups."""
    return F.struct(c.isNull().alias("none"), F.coalesce(c, F.lit("")).alias("some"))


def unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the seed and the values, by MD5: 52 bits, the same in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
