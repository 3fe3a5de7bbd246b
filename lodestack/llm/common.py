"""What the corpus operators share: table access, words and keys of texts, and the library's storage.

Internal columns start with ``_ls_`` so that they never clash with columns of the caller's table.
"""

from __future__ import annotations

import contextlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, same_table, save, scope, small  # noqa: F401

#: ASCII white space as the contracts name it; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the actions inside; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def text_key(text: Column) -> Column:
    """64-bit digest of a text; with ``doc_id`` it names a row by content, so repeated rows share one verdict."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def held_out(doc_id: Column) -> Column:
    """True for the quarter of rows that no model learns from: ``crc32(doc_id as text) mod 4 = 2``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (``left_semi``) or without (``left_anti``) their content key in ``keys(_ls_id, _ls_th)``."""
    keyed = docs.withColumns({"_ls_id0": F.col("doc_id"), "_ls_th0": text_key(F.col("text"))})
    on = keyed["_ls_id0"].eqNullSafe(keys["_ls_id"]) & (keyed["_ls_th0"] == keys["_ls_th"])
    return keyed.join(keys, on, how).select(*docs.columns)


def rows_of(names: list[str], types: list[pa.DataType], rows) -> pa.StructArray:
    """An Arrow struct array of tuples; texts are taken one at a time, so a batch's texts never are Python objects together."""
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
