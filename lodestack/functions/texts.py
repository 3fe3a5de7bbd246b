"""Text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, so that every engine cuts alike whatever the text holds.
SPACE = "[ \t\r\n]+"

IMAGE_NAME = r"[^\s]+\.(?i)(jpg|jpeg|png|gif|bmp)$"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def prefixed(words: Column, prefix: str = "vw") -> Column:
    """Terms of a modality: each word with the modality's prefix."""
    return F.transform(words, lambda w: F.concat(F.lit(prefix), w.cast("string")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def stem(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(1))


def synset(path: Column) -> Column:
    """The class a test image's name starts with: ``<synset>_<n>.jpg``."""
    return F.split_part(basename(path), F.lit("_"), F.lit(1))


def is_image(path: Column) -> Column:
    return path.rlike(IMAGE_NAME) & ~path.endswith("~")


def feature_fields(line: Column, n: int = 128) -> Column:
    """``scale orientation x y d0 d1 ...`` as a struct."""
    f = F.split(F.btrim(line), r"\s+")
    field = lambda i: F.element_at(f, i + 1).cast("double")
    return F.struct(
        field(0).alias("scale"), field(1).alias("orientation"), field(2).alias("x"), field(3).alias("y"), F.slice(f, 5, n).cast("array<double>").alias("descriptor")
    )


def inside(x: Column, y: Column, x1, y1, x2, y2) -> Column:
    """Bounding box, borders included."""
    return x.between(x1, x2) & y.between(y1, y2)


def fit_ratio(width: Column, height: Column, limit: int = 2048) -> Column:
    """Factor that fits an image into a square of ``limit`` without enlarging it."""
    return F.least(F.lit(1.0), F.try_divide(F.lit(float(limit)), width), F.try_divide(F.lit(float(limit)), height))


def ends_with_any(name: Column, suffixes: list[str]) -> Column:
    """Whether a name ends with one of the suffixes."""
    found = F.lit(False)
    for x in suffixes:
        found = found | name.endswith(x)
    return found


def suffixed(name: Column, suffix: str) -> Column:
    """A name with a suffix put before its extension."""
    return F.when(name.contains("."), F.regexp_replace(name, r"(\.[^.]*)$", f"{suffix}$1")).otherwise(F.concat(name, F.lit(suffix)))
