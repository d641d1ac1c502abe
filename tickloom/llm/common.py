"""Shared pieces: document columns, the white-space class, tables written to the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import fits_broadcast, ship_by_value, work_dir

#: Columns of a documents table, in order.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

#: ASCII white space as regular-expression classes, and as the characters themselves.
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and it is computed once."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """Mark ``df`` for a broadcast if its measured size allows one; else it joins by a shuffle."""
    return F.broadcast(df) if fits_broadcast(df) else df


def bound_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def id_text(name: str = "doc_id") -> Column:
    """The id as text: pandas would turn a column of integers with a null into floats."""
    return F.col(name).cast("bigint").cast("string").alias(name)


def id_back(name: str = "doc_id") -> Column:
    return F.col(name).cast("bigint").alias(name)


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def release_memory() -> None:
    """Give memory that Arrow and the C library hold free back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def returning(work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]):
    """``work`` for ``mapInPandas``; after it, the worker, which waits for more tasks, returns the memory that it used."""
    ship_by_value(__name__)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from work(frames)
        release_memory()

    return run
