"""Operator 9: quality scores by nearest-neighbour voting in a latent semantic space.

Terms are a text's byte bigrams, hashed to ``BINS``, and four of its structure: words equal to the word before, words
seen before in the text, lines seen before, symbol characters. A term's value is the square root of its share of the
text's bytes (of its words, for the first three of structure). All terms are treated alike: centred, and scaled by their
deviation in the labelled sample plus the mean deviation. The ``RANK`` leading right singular vectors of the sample span
the latent space. The labelled vectors are broadcast (``SAMPLE`` x ``RANK`` floats, a fixed size). Every document is
compared with all of them by exact cosine products in blocks; its ``NEIGHBOURS`` nearest vote with their similarities to
the eighth power, and the score is the share of the votes for label 1, drawn a little (``PULL``) towards the sample's.

Learning: of the labelled rows that are not held out, per label the ``SAMPLE / 2`` of smallest ``xxhash64(doc_id)``. Their
terms are counted over whole texts where the texts are, and only counts reach the driver.

Cases: null and empty texts get the sample's share of label 1; without labels all scores are 0.5; ties of similarity go
to the sample row first in order (by ``doc_id``, then label); a ``doc_id`` with both labels is two sample rows, the same
label twice is one; of several texts of a labelled ``doc_id`` the first in order is learned from; repeated rows are rows
like others; texts of any length are counted whole; an empty table gives an empty result; only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import held_out

BINS, RANK, SAMPLE, NEIGHBOURS, BLOCK_ROWS = 2048, 48, 2400, 15, 256
EXTRA = 5
#: Strength of the sample's own share in a vote.
PULL = 0.1
CUT = 0.7

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>!{}=~^_\\@")] = True


def counts(column: pa.Array):
    """Blocks of term counts: a float32 matrix for each run of at most ``BLOCK_ROWS`` rows of a string array."""
    data, at = hashing.texts(column)
    for first, last in hashing.blocks(at):
        for lo in range(first, last, BLOCK_ROWS):
            hi = min(lo + BLOCK_ROWS, last)
            part = at[lo : hi + 1] - at[lo]
            yield _counts(data[at[lo] : at[hi]], part)


def _repeats(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Per row: values that occurred before in it."""
    return np.diff(to) - np.diff(hashing.sets(values, to)[1])


def _counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = len(at) - 1
    out = np.zeros((rows, BINS + EXTRA), np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(rows), np.diff(at))
    wide = data.astype(np.int64)
    pair = (wide[:-1] * 2654435761 + wide[1:] * 40503 >> 5) % BINS
    same = row[:-1] == row[1:]
    flat = np.bincount(row[:-1][same] * BINS + pair[same], minlength=rows * BINS)
    out[:, :BINS] = flat.reshape(rows, BINS)
    found, to = hashing.word_hashes(data, at, lower=False)
    word_row = np.repeat(np.arange(rows), np.diff(to))
    again = (found[1:] == found[:-1]) & (word_row[1:] == word_row[:-1])
    out[:, BINS] = np.diff(to)
    out[:, BINS + 1] = np.bincount(word_row[1:][again], minlength=rows)
    out[:, BINS + 2] = _repeats(found, to)
    out[:, BINS + 3] = _line_repeats(data, at, row)
    out[:, BINS + 4] = np.bincount(row[_SYMBOL[data]], minlength=rows)
    return out


def _line_repeats(data: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Per row: lines equal to an earlier one, by line hashes made like word hashes."""
    up, down = hashing._Powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(hashing._BYTE[data] * up[: len(data)], out=total[1:])
    stop = data == 10
    starts = np.flatnonzero(np.concatenate([[True], stop[:-1] | (row[1:] != row[:-1])]))
    ends = np.concatenate([starts[1:], [len(data)]])
    lines = hashing.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return _repeats(lines, np.searchsorted(starts, at))


def _right_vectors(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from fixed random vectors; memory is a few times ``x``."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank]).astype(np.float32)


def shares(raw: np.ndarray) -> np.ndarray:
    """Square roots of the terms' shares; a row without bytes is zero."""
    size, words = np.maximum(raw[:, :BINS].sum(axis=1, keepdims=True), 1), np.maximum(raw[:, BINS : BINS + 1], 1)
    return np.sqrt(np.concatenate([raw[:, :BINS] / size, raw[:, BINS + 1 : BINS + 4] / words, raw[:, BINS + 4 :] / size], axis=1))


class Space:
    """Centre and scale of the terms, latent basis and the labelled vectors."""

    def __init__(self, raw: np.ndarray, labels: np.ndarray):
        self.share, self.labels = float(labels.mean()) if len(labels) else 0.5, labels.astype(np.float32)
        self.centre = self.scale = self.basis = self.vectors = None
        if len(labels):
            found = shares(raw)
            self.centre, spread = found.mean(axis=0), found.std(axis=0)
            self.scale = 1 / np.maximum(spread + spread.mean(), 1e-12)
            self.basis = _right_vectors((found - self.centre) * self.scale, RANK)
            self.vectors = self._latent(found)

    def _latent(self, found: np.ndarray) -> np.ndarray:
        x = ((found - self.centre) * self.scale) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(raw), 0.5)
        near = self._latent(shares(raw)) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        above = near > least
        tied = near == least
        chosen = above | tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True))
        weight = np.where(chosen, np.maximum(near, 0) ** 8, 0)
        out = ((weight @ self.labels + PULL * self.share) / (weight.sum(axis=1) + PULL)).astype(np.float64)
        return np.where(raw.any(axis=1), np.clip(out, 0, 1), self.share)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space:
    """The space of a sample of at most ``sample`` labelled rows, whose counts are collected to the driver."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    rows = rows.withColumn("_ls_h", F.xxhash64("doc_id"))
    totals = rows.groupBy("quality").agg(F.count("*").alias("_ls_k"))
    near = F.least(F.lit(1.0), 2.0 * sample / F.col("_ls_k"))
    rows = rows.join(F.broadcast(totals.select("quality", near.alias("_ls_near"))), "quality").where(F.col("_ls_h") / F.lit(2.0**64) + 0.5 <= F.col("_ls_near"))
    order = Window.partitionBy("quality").orderBy("_ls_h", "doc_id")
    chosen = sorted((r.doc_id, r.quality) for r in rows.withColumn("_ls_n", F.row_number().over(order)).where(f"_ls_n <= {sample // 2}").collect())
    texts = docs.where(F.col("doc_id").isin(sorted({i for i, _ in chosen}))).groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            at = 0
            for raw in counts(batch.column("text")):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]), pa.array(raw.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(raw)), flat], ["doc_id", "raw"])
                at += len(raw)

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = {r.doc_id: r.raw for r in texts.mapInArrow(run, f"doc_id {kind}, raw array<float>").collect()}
    chosen = [x for x in chosen if x[0] in found]
    return Space(np.array([found[i] for i, _ in chosen], np.float32).reshape(-1, BINS + EXTRA), np.array([q for _, q in chosen], float))


def scored(docs: DataFrame, space: Space) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        for batch in batches:
            parts = [shared.value.scores(raw) for raw in counts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.empty(0))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
