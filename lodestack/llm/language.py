"""Operator 10: language identification by compression.

For each language seen in the labelled rows one raw-content dictionary is made from a bounded sample of their texts. A
text is cut into pieces of ``PIECE`` bytes and every piece compressed with each language's dictionary; the language of
the smallest total wins. The margin is the relative distance of the runner-up, ``1 - smallest / next``; below ``MARGIN``
the text is rejected. The score is ``margin / (margin + MARGIN)``, so a half is the border.

Learning (bounds are parameters): of the rows with a language that are not held out and whose texts have at most
``LONGEST`` bytes, per language the ``SAMPLE`` of smallest ``xxhash64(doc_id)``. Their whole texts make the dictionary, in
that order, as far as they fit into ``SIZE`` bytes (a text that doesn't fit is passed over).

Cases: null texts and texts without a letter are ``und`` with score 0 and rejected; with no learned language all texts
are ``und``; with one, it is predicted with score 1; equal totals go to the language first in order; repeated rows and
rows with a null ``doc_id`` are rows like others; a text of any length is compressed piece by piece; an empty table gives
an empty result; only ``doc_id``, ``text`` and ``lang`` are read, and other columns, of any name, are carried by the
pipeline's stage.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, rows_of

SAMPLE, LONGEST, SIZE = 144, 16384, 32768
PIECE, LEVEL, MARGIN = 2048, 12, 0.002

_LETTER = regex.compile(r"\p{L}")
_LETTERS = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower case in UTF-8, every run of ASCII characters that aren't letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def learn(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, size: int = SIZE) -> dict[str, bytes]:
    """The dictionary's content for each language. What reaches the driver is ``sample * longest`` bytes a language at most.

    First only lengths are read of the texts, to count the languages and to choose the share of hashes that holds about
    four times the sample; then the few rows under it are ranked and their texts fetched.
    """
    fits = F.octet_length("text").between(1, longest)
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & fits).withColumn("_ls_h", F.xxhash64("doc_id"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("_ls_k"))
    near = F.least(F.lit(1.0), 4.0 * sample / F.col("_ls_k"))
    chosen = rows.select("lang", "doc_id", "_ls_h").join(F.broadcast(counts.select("lang", near.alias("_ls_near"))), "lang")
    chosen = chosen.where(F.col("_ls_h") / F.lit(2.0**64) + 0.5 <= F.col("_ls_near"))
    order = Window.partitionBy("lang").orderBy("_ls_h", "doc_id")
    ids = [r.doc_id for r in chosen.withColumn("_ls_n", F.row_number().over(order)).where(f"_ls_n <= {sample}").select("doc_id").distinct().collect()]
    texts = rows.where(F.col("doc_id").isin(ids)).select("lang", "_ls_h", "doc_id", "text").distinct()
    found: dict[str, list[bytes]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r.lang, r._ls_h, r.doc_id, r.text)):
        parts, part = found.setdefault(r.lang, []), plain(r.text)
        if part and sum(map(len, parts)) + len(part) <= size:
            parts.append(part)
    return {lang: b" ".join(parts) for lang, parts in found.items() if parts}


class Model:
    def __init__(self, contents: dict[str, bytes]):
        self.contents, self.ready = contents, None

    def __getstate__(self):
        return self.contents

    def __setstate__(self, contents):
        self.__init__(contents)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is rejected."""
        if not self.contents or not text or not _LETTER.search(text):
            return "und", 0.0, True
        if self.ready is None:
            self.ready = [(lang, self._packer(self.contents[lang])) for lang in sorted(self.contents)]
        if len(self.ready) == 1:
            return self.ready[0][0], 1.0, False
        data = plain(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = sorted((sum(len(pack(p)) for p in pieces), lang) for lang, pack in self.ready)
        margin = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], margin / (margin + MARGIN), margin < MARGIN

    @staticmethod
    def _packer(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def predicted(docs: DataFrame, contents: dict[str, bytes]) -> Column:
    """Column of ``struct<lang_pred, score, rejected>`` for the column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(contents))

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        model = shared.value
        return rows_of(["lang_pred", "score", "rejected"], [pa.string(), pa.float64(), pa.bool_()], (model.predict(t.as_py()) for t in texts))

    return run("text")


def op10(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``."""
    found = docs.select("doc_id", predicted(docs, learn(docs)).alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score", "p.rejected")


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that are rejected go."""
    return docs.where(~predicted(docs, learn(docs))["rejected"])
