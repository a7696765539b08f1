"""Shared pieces of the corpus operators: tables, folds, intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.session import materialize, scratch_dir

__all__ = ["arrow_rows", "floors", "fold_of", "free_names", "hash_of_rows", "keep_only", "materialize", "pieces_of", "prepare", "scratch_dir", "table", "whole"]

#: Rows per Arrow batch. Documents can be long, so the rows that wait for Python are few.
BATCH_ROWS = 1_000

#: Byte table that lowers A-Z and leaves all else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hash_of_rows(df: DataFrame, seed: int = 0) -> Column:
    """Hash of all columns that can be hashed, with which of them are null; maps can't be hashed."""
    fine = [df[c] for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(F.lit(seed), *fine, *[c.isNull() for c in fine])


_owner = ""


def keep_only(owner: str) -> None:
    """Drops the tables that other operators have left in this worker process, when ``owner`` is the next to work in it.

    Workers outlive a stage, and a module whose tables outlive a task drops them in its ``forget``. Nothing is lost but
    the time to fill a table anew. What is freed goes back to the system, as other workers and the JVM share its memory.
    """
    global _owner
    if _owner == owner:
        return
    _owner = owner
    package = __name__.rpartition(".")[0]
    for name, module in list(sys.modules.items()):
        if name.startswith(f"{package}.") and name != f"{package}.{owner}" and hasattr(module, "forget"):
            module.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces_of(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Regroups the batches of a partition into tables of about ``most_bytes`` of ``column``.

    A row is never split, so a longer text makes a table of its own.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            grown = sum(len(x) for x in part.column(column).to_pylist() if x is not None)
            if held and size + grown > most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += grown
    if held:
        yield pa.Table.from_batches(held)


def whole(vector: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of every component as a whole number of any size."""
    return [int(x) * scale if abs(x) >= 2.0**53 else math.floor(scale * x) for x in vector.tolist()]


def floors(vector: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, infinite where that is too large."""
    with np.errstate(over="ignore"):
        y = vector * scale
    return np.where(np.abs(y) < 2.0**53, np.floor(y), y)


def arrow_rows(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    """A batch of ``schema`` from one sequence or array per field."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in ((f, columns[f.name]) for f in schema)],
        schema=schema,
    )
