"""What the corpus operators share: table access, Arrow helpers and skew-proof ranks."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows handed to Python at a time are cut so that their texts stay near this many bytes.
SLICE_BYTES = 4 << 20


#: What a Python worker keeps from task to task: one encoder at most, whatever ran in the worker before.
_held: dict[tuple, object] = {}


def hold(key: tuple, make: Callable[[], object]) -> object:
    """The worker's object of this key; objects of other keys are given up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


_tuned = False


def let_go(key: tuple | None = None) -> None:
    """Called where a task begins or ends: give up what was held for others than ``key``, and return memory to the system.

    Workers outlive their tasks, and several share an executor with its JVM: what one keeps, the others lack. Large
    arrays are mapped each by itself, so that they go back when they are freed.
    """
    global _tuned
    if any(k != key for k in _held):
        _held.clear()
    gc.collect()
    try:
        libc = ctypes.CDLL(None)
        if not _tuned:
            pa.set_memory_pool(pa.system_memory_pool())
            libc.mallopt(-8, 2)  # arenas
            libc.mallopt(-3, 1 << 18)  # bytes from which an array is mapped by itself
            _tuned = True
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str, folder: str | None = None) -> str:
    """A vocabulary file of a public tokenizer: in ``folder``, or where their package has it."""
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no piece holds much more than SLICE_BYTES of ``column`` (one row at least)."""
    for b in batches:
        rows = max(1, min(b.num_rows, int(b.num_rows * SLICE_BYTES / max(1, b.column(column).nbytes))))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def per_row(df: DataFrame, keep: list[str], column: str, schema: str, make: Callable[[], Callable], keep_as: str | None = None, held: tuple | None = None) -> DataFrame:
    """Append columns computed in Python from one string column.

    ``make`` runs once a task and returns a function from a list of strings (nulls included) to a list of columns.
    The columns in ``keep`` travel along unchanged, and so does the string column under the name ``keep_as``; a row
    never leaves its partition. ``held`` names the object that ``make`` takes from ``hold``, if any.
    """
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    added = [tuple(x.strip().split(" ", 1)) for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(held)
        work = make()
        for b in slices(batches, "_in"):
            columns = work(b.column("_in").to_pylist())
            old = [b.column(c) for c in keep] + [b.column("_in")] * bool(keep_as)
            yield pa.RecordBatch.from_arrays(old + [pa.array(v, arrow[t]) for v, (_, t) in zip(columns, added)], names=[*keep, *[keep_as] * bool(keep_as), *[n for n, _ in added]])
        b = columns = old = work = None  # noqa: F841
        let_go(held)

    kinds = dict(df.dtypes)
    slim = df.select(*[F.col(f"`{c}`") for c in keep], F.col(column).alias("_in"))
    return slim.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{keep_as}` string"] * bool(keep_as) + [schema]))


def with_rank(df: DataFrame, key: list[str], order: list[Column], pid: str, name: str = "rank") -> DataFrame:
    """Number the rows of each key from 0 without gaps, whatever share of the rows one key holds.

    ``pid`` is a column that splits every key into bounded parts (the input partition a row came from). Rows are
    numbered within (key, part); a running total over the parts of a key, one small row each, shifts them. Only
    the totals meet by key, so no task sees all rows of a hot key.
    """
    part = df.groupBy(*key, pid).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    shift = part.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = df.withColumn("_i", F.row_number().over(Window.partitionBy(*key, pid).orderBy(*order)) - 1)
    for k in key:  # a null key is a key like any other
        shift = shift.withColumnRenamed(k, f"_k_{k}")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    shift = shift.withColumnRenamed(pid, "_k_pid")
    joined = inner.join(shift, [*on, F.col(pid) == F.col("_k_pid")])
    return joined.withColumn(name, (F.col("_i") + F.col("_shift")).cast("long")).drop("_i", "_shift", "_k_pid", *[f"_k_{k}" for k in key])


def packed(docs: DataFrame, text: str) -> DataFrame:
    """(_rest, _text): all other columns as one struct of numbered fields, so that no name can clash on the way."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("_rest"), F.col(f"`{text}`").alias("_text"))


def unpacked(docs: DataFrame, text: str, new_text: Column | str = "_text") -> list[Column]:
    """The columns of ``docs`` again, in their order, out of a table made by ``packed``."""
    rest = [c for c in docs.columns if c != text]
    back = {c: F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(rest)}
    new = F.col(new_text) if isinstance(new_text, str) else new_text
    return [back.get(c, new.alias(c)) for c in docs.columns]


#: A side of a join is broadcast where its rows, counted first, take no more than this many bytes.
BROADCAST_BYTES = 48 << 20


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``ids`` (distinct, one column, already written down).

    The ids are counted: few enough go to every task, so that ``df`` isn't shuffled; beyond that both sides are.
    """
    return df.join(_sized(ids), key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among ``ids``, with the same care."""
    return df.join(_sized(ids), key, "left_anti")


def _sized(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() * 24 <= BROADCAST_BYTES else ids
