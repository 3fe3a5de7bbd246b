"""Feature extraction as a table function: a blob in, a row for each descriptor out.

The extractor is a plug-in ``bytes -> iterable of (scale, orientation, x, y, descriptor)``; it runs once a batch in Python
workers. Blobs that it cannot read are dropped; ``observed`` counts blobs and descriptors while the job runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import vectors
from . import files

Feature = tuple[float, float, float, float, list[float]]

_SCHEMA = "image_id string, scale double, orientation double, x double, y double, descriptor array<float>"
_ARROW = pa.schema([("image_id", pa.string()), *((c, pa.float64()) for c in ("scale", "orientation", "x", "y")), ("descriptor", pa.list_(pa.float32()))])
_CHUNK = 2000


def extract(blobs: DataFrame, extractor: Callable[[bytes], Iterable[Feature]], name: str = "path", content: str = "content") -> DataFrame:
    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for key, data in zip(batch.column(0), batch.column(1)):
                try:
                    found = list(extractor(data.as_py()))
                except Exception:  # a plug-in may fail in any way on a broken picture
                    continue
                rows += [(key.as_py(), *map(float, f[:4]), [float(x) for x in f[4]]) for f in found]
                while len(rows) >= _CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[:_CHUNK]), _ARROW.types)], schema=_ARROW)
                    rows = rows[_CHUNK:]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return blobs.select(F.col(name).cast("string"), content).mapInArrow(run, _SCHEMA)


def extract_folder(spark, path: str, extractor: Callable[[bytes], Iterable[Feature]]) -> DataFrame:
    """Descriptors of all pictures under a folder."""
    return extract(files.images(spark, path).where("length > 0"), extractor)


def byte_descriptors(features: DataFrame) -> DataFrame:
    """``features`` with whole numbers from -127 to 127 as descriptors."""
    return features.withColumn("descriptor", vectors.quantize_bytes(F.col("descriptor")))


def observed(features: DataFrame) -> tuple[DataFrame, Observation]:
    """``features`` and an observation that holds ``n_features`` after an action."""
    seen = Observation("features")
    return features.observe(seen, F.count("*").alias("n_features")), seen


def byte_histogram(data: bytes, patch: int = 64, bins: int = 16) -> list[Feature]:
    """A toy extractor for tests and plain files: histograms of patches of bytes."""
    raw = np.frombuffer(data, np.uint8)
    out = []
    for i in range(0, len(raw), patch):
        part = raw[i : i + patch]
        out.append((1.0, 0.0, float(i), 0.0, np.histogram(part, bins, (0, 256))[0].astype(float).tolist()))
    return out
