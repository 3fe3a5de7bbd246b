"""Operator 5: document near-deduplication by fast similarity sketching, banding and exact verification.

A text's set is its distinct shingles of ``size`` words (ASCII letters in lower case); a text with fewer words is one
shingle, a text without words has an empty set and no links. Documents whose sets have a Jaccard similarity of
``percent`` or more are linked, and a group is a connected component of links.

Sketch (Dahlgaard, Knudsen and Thorup 2017): ``T`` coordinates are filled in rounds. In round i < T every element falls
into a hashed bin with a hashed value and offers i + value there; in round T + i every element offers to bin i. Rounds
end when all bins have an offer, so every coordinate is filled after 2 T rounds at most, and a set of T log T elements
or more is mostly done after one. Coordinates agree with probability equal to the similarity, with the concentration
of T independent ones. Bands of ``ROWS`` coordinates are joined: a pair of similarity 0.8 is missed with probability
(1 - 0.8^7)^48 = 1.2e-5. Candidates are confirmed on the full sets of 64-bit shingle hashes.

Equal sets (two 64-bit digests) are one class from the start, so copies cost one row each and are never paired.

Cases: a null text has an empty set; repeated rows are members of one class; a null ``doc_id`` is never a group's
name unless all its members have none; a text of any length is hashed whole, piece by piece; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read, and other columns are carried by the pipeline's stage (names that
start with ``_ls_`` are the library's own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import arrow_batches, matching, save, scope, small, text_key
from .graph import buckets, link

T, ROWS, BANDS = 336, 7, 48
PERCENT = 80

#: Offers that are made at once, and rows of an Arrow batch: both bound a worker's memory.
ROUND_ITEMS, BATCH_ROWS = 20_000, 500

_SEED = 0xD1B54A32D192ED03


def sketch(items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of ``T`` coordinates for each non-empty set; rows of empty sets hold the largest number."""
    rows = len(at) - 1
    out = np.full((rows, T), 2**64 - 1, np.uint64)
    n = np.diff(at)
    open_, turn, step = np.flatnonzero(n), 0, 1
    # a coordinate is the round in its upper bits and the value below, so the earliest offer wins and rounds may be
    # taken several at a time
    while turn < 2 * T and len(open_):
        take = items if len(open_) == rows else np.concatenate([items[at[r] : at[r + 1]] for r in open_])
        row = np.repeat(open_, n[open_])[None, :]
        turns = np.arange(turn, min(turn + step, 2 * T if turn >= T else T), dtype=np.uint64)[:, None]
        mixed = hashing.mix(take[None, :] + np.uint64(_SEED) * (turns + np.uint64(1)))
        value = turns << np.uint64(53) | mixed >> np.uint64(11)
        if turn < T:
            place = (hashing.mix(mixed ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(T)).astype(np.int64)
        else:
            place = (turns.astype(np.int64) - T) + np.zeros_like(row)
        np.minimum.at(out.reshape(-1), (row * T + place).reshape(-1), value.reshape(-1))
        turn += len(turns)
        open_ = open_[(out[open_] == np.uint64(2**64 - 1)).any(axis=1)]
        step = max(1, min(64, ROUND_ITEMS // max(1, int(n[open_].sum()))))
    return out


def _digests(items: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set: sums of differently mixed elements."""
    sums = []
    for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashing.mix(items ^ np.uint64(salt)))])
        sums.append(hashing.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
    return sums[0], sums[1]


def _sets_of(batch: pa.RecordBatch, size: int):
    """Blocks of a batch: first and last row, the rows' sets and their offsets."""
    data, at = hashing.texts(batch.column("text"))
    for first, last in hashing.blocks(at):
        part = at[first : last + 1]
        found, words = hashing.word_hashes(data[part[0] : part[-1]], part - part[0])
        yield first, last, *hashing.sets(*hashing.shingles(found, words, size))


def _list(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.ascontiguousarray(values)))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``(_ls_id, _ls_th, n, d1, d2, keys)`` of every row: set size, set digests and band keys (none if empty)."""

    def run(batches):
        for batch in batches:
            for first, last, items, at in _sets_of(batch, size):
                d1, d2 = _digests(items, at)
                rows = sketch(items, at).reshape(last - first, BANDS, ROWS)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
                for k in range(ROWS):
                    keys = hashing.mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
                full = np.diff(at) > 0
                to = np.concatenate([[0], np.cumsum(full * BANDS)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_ls_id").slice(first, last - first), batch.column("_ls_th").slice(first, last - first), pa.array(np.diff(at)), pa.array(d1), pa.array(d2), _list(keys[full].reshape(-1).view(np.int64), to)],
                    ["_ls_id", "_ls_th", "n", "d1", "d2", "keys"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("_ls_id"), text_key(F.col("text")).alias("_ls_th"), "text")
    return rows.mapInArrow(run, f"_ls_id {kind}, _ls_th long, n long, d1 long, d2 long, keys array<long>")


def _class_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(id, items)``: the full sets of the classes ``wanted(id, first)``, from each class's first row only."""

    def run(batches):
        for batch in batches:
            for first, last, items, at in _sets_of(batch, size):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), _list(items.view(np.int64), at)], ["id", "items"])

    keys = wanted.select("id", F.col("first.i").alias("_ls_i"), F.col("first.t").alias("_ls_t"))
    rows = docs.select(F.col("doc_id").alias("_ls_id"), text_key(F.col("text")).alias("_ls_th"), "text")
    rows = rows.join(small(keys), F.col("_ls_id").eqNullSafe(F.col("_ls_i")) & (F.col("_ls_th") == F.col("_ls_t"))).select("id", "text")
    return rows.mapInArrow(run, "id long, items array<long>").dropDuplicates(["id"])


def groups(docs: DataFrame, size: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(rows, classes)``: every row with its class digests, and every class with its group.

    rows: ``_ls_id, _ls_th, n, d1, d2``. classes: ``d1, d2, group_id`` (the group's smallest doc_id), ``first`` (the
    group's first row: struct of null flag, doc_id and text digest).
    """
    with scope(docs.sparkSession) as keep:
        rows, found = _groups(docs, size, percent)
        return keep(rows).drop("keys"), keep(found)


def _groups(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        rows = save(sketches(docs, size), "sketches")
    at = F.struct(F.col("_ls_id").isNull().alias("n"), F.col("_ls_id").alias("i"), F.col("_ls_th").alias("t"))
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("_ls_id").alias("low"), F.min(at).alias("first"))
    classes = save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    named = classes.select("id", "d1", "d2")
    keys = rows.where("n > 0").select("d1", "d2", "keys").dropDuplicates(["d1", "d2"]).join(named, ["d1", "d2"])
    members = save(buckets(save(keys.select("id", "keys"), "keys")), "members")
    wanted = members.select("id").distinct().join(classes.select("id", "first"), "id")
    wanted = save(wanted, "wanted")
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        sets = save(_class_sets(docs, wanted, size), "sets")
    roots = link(members, sets, percent)
    linked = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = linked.groupBy("root").agg(F.min("low").alias("group_id"), F.min("first").alias("group_first"))
    out = linked.join(best, "root").select("d1", "d2", "group_id", F.col("group_first").alias("first"))
    return rows, save(out, "groups")


def op5(docs: DataFrame, size: int = 2) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (its own id if it has no link) and ``kept``."""
    rows, classes = groups(docs, size)
    out = rows.join(classes.select("d1", "d2", "group_id"), ["d1", "d2"], "left")
    group = F.coalesce("group_id", "_ls_id")
    return out.select(F.col("_ls_id").alias("doc_id"), F.col("n").alias("n_shingles"), group.alias("component_id"), F.col("_ls_id").eqNullSafe(group).alias("kept"))


def stage(docs: DataFrame, size: int = 5) -> DataFrame:
    """The pipeline's stage: one document of each group stays, the first by doc_id (null last) and text digest.

    Rows that are equal in doc_id and text are one document too: one of them stays. Texts without words stay.
    """
    rows, classes = groups(docs, size)
    tagged = rows.join(classes.select("d1", "d2", "first"), ["d1", "d2"], "left")
    first = F.col("first").isNull() | (F.col("first.i").eqNullSafe(F.col("_ls_id")) & (F.col("first.t") == F.col("_ls_th")))
    verdicts = save(tagged.groupBy("_ls_id", "_ls_th").agg(F.min(first).alias("stays"), F.count("*").alias("times")), "verdicts")
    gone = verdicts.where(~F.col("stays")).select("_ls_id", "_ls_th")
    again = verdicts.where(F.col("stays") & (F.col("times") > 1)).select("_ls_id", "_ls_th")
    left = matching(docs, small(gone), "left_anti")
    if again.isEmpty():
        return left
    twice = matching(left, small(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return matching(left, small(again), "left_anti").unionByName(twice)
