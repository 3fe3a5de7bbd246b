"""Operator 2: corpus-wide fuzzy line deduplication by MinHash.

A line takes part if it holds a word. It is compared trimmed and in lower case, by the set of its shingles: the ``SHINGLE``
bytes of its UTF-8 form from each byte on, so 12 characters of Latin and 4 of Chinese text, from each character on (a
shorter line is one shingle). Lines with a Jaccard similarity of ``PERCENT`` or more are linked; of each component of
links the first line stays (smallest ``doc_id``, null last, then text digest, then line number), all others go. Lines
without a word always stay.

1. Signatures: lines with equal 128-bit names are one class. A class's shingles are hashed and dealt over ``BINS`` bins,
   and the smallest hash in each bin is a coordinate (one-permutation MinHash; an empty bin takes another bin's).
   Of a line of ``KEEP`` shingles or more only hashes under a limit that leaves half ``KEEP`` to ``KEEP`` of them reach the
   aggregate: a bin's smallest hash is among them if any of the bin's is. Lines of which this leaves ``EMPTY`` bins
   without one, as they repeat few shingles, are read in one text each and done again without the limit.
2. Bands: ``BANDS`` triples of bins, of which no two have two bins in common.
3. Links: exact verification on the full shingle sets, hubs and components as in ``graph``.

Recall: of 4,000 simulated pairs at similarity 0.8 the bands miss 1.1 % if both lines have 5 shingles together, 0.5 % with
10, and 0.1 to 0.4 % with 15 to 120; above 0.8 it is less.

Cases: null and empty texts hold no line and stay as they are; repeated rows (same ``doc_id`` and text) are one row;
equal lines inside one text are duplicates too; a text of any length and number of lines is cut the same way, its lines
as rows of their own; an empty table gives an empty result; other columns are carried (names that start with ``_ls_`` are
the library's own).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, scope, small, text_key
from .graph import KEY_ROWS, buckets, link

SHINGLE, BINS, BANDS, PERCENT = 12, 16, 12, 80
KEEP, EMPTY = 96, 4

#: Bins of each band. The differences 1, 2 and 3 occur once each, so two bands share one bin at most.
_TRIPLES = [[(5 * j + k) % BINS for k in (0, 1, 3)] for j in range(BANDS)]

#: The bins that an empty bin takes its coordinate from, in order.
_OTHERS = [random.Random(j).sample([k for k in range(BINS) if k != j], BINS - 1) for j in range(BINS)]


def _cut(text: Column) -> Column:
    """All lines of a text, in lower case; trimming is left to ``_trimmed``."""
    return F.split(F.lower(text), "\n")


def _trimmed(line: Column) -> Column:
    # trimming by a set of characters reads the whole line, so it is left to lines with other than spaces at an end
    short = F.trim(line)
    odd = [short.startswith(c) | short.endswith(c) for c in "\t\r\x0b\x0c"]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3], F.btrim(line, F.lit(" \t\r\x0b\x0c"))).otherwise(short)


def _name(line: Column) -> list[Column]:
    """A line's 128-bit name."""
    return [F.xxhash64(line).alias("i1"), F.xxhash64(F.lit(1), line).alias("i2")]


def _windows(octets: Column) -> Column:
    return F.greatest(F.octet_length(octets) - (SHINGLE - 1), F.lit(1))


def _hash(octets: Column, i: Column) -> Column:
    return F.xxhash64(F.call_function("substring", octets, i, F.lit(SHINGLE)))


def shingles(line: Column) -> Column:
    """64-bit hashes of a line's shingles, repeated ones too."""
    # the line is bound as an element of an array, as a column would be copied for each shingle
    sets = F.transform(F.array(line.cast("binary")), lambda b: F.transform(F.sequence(F.lit(1), _windows(b)), lambda i: _hash(b, i)))
    return sets[0]


def _limit(n: Column) -> Column:
    """The largest hash that is taken of a line of n shingles."""
    out = F.when(n < KEEP, F.lit(2**63 - 1))
    for level in range(1, 24):
        out = out.when(n < KEEP << level, F.lit(-(2**63) + 2 ** (64 - level) - 1))
    return out.otherwise(F.lit(-(2**63) + 2**40 - 1))


def _lines(docs: DataFrame) -> DataFrame:
    """``(_ls_id, _ls_th, line_no, line)`` of every line with a word, normalised."""
    cut = docs.select(F.col("doc_id").alias("_ls_id"), text_key(F.col("text")).alias("_ls_th"), F.posexplode(_cut(F.col("text"))).alias("line_no", "raw"))
    return cut.select("_ls_id", "_ls_th", "line_no", _trimmed(F.col("raw")).alias("line")).where("line <> ''")


def _coordinates(lines: DataFrame, limit) -> DataFrame:
    """``(i1, i2, n, copies, text, m0, m1, ...)``: for each class of ``lines(text, line)`` the smallest hash in each bin,
    and the largest digest of a text that holds it.

    Shingles are rows for a moment only, inside one stage: what is shuffled is a row for each class and task.
    """
    # what is made of a whole line comes in a projection below the explosion, else it would be made for each shingle
    named = lines.select("text", *_name(F.col("line")), F.col("line").cast("binary").alias("b"))
    named = named.select("text", "i1", "i2", "b", _windows(F.col("b")).alias("n"), limit(_windows(F.col("b"))).alias("most"))
    rows = named.select("text", "i1", "i2", "n", "most", "b", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    # the partition's number keeps the condition above this projection; below it each hash would be made twice
    low = rows.select("text", "i1", "i2", "n", "i", "most", _hash(F.col("b"), F.col("i")).alias("h"), F.spark_partition_id().alias("part"))
    low = low.where("(h <= most or i = 1) and part >= 0")
    low = low.withColumn("bin", F.when(F.col("h") <= F.col("most"), F.col("h").bitwiseAND(F.lit(BINS - 1)).cast("int")).otherwise(-1))
    # a filter leaves the other bins' buffers alone, where a condition inside the function would write all of them for each shingle
    once = [F.expr("count(1) filter (where i = 1)").alias("copies"), F.expr("max(text) filter (where i = 1)").alias("text")]
    mins = [F.expr(f"min(h) filter (where bin = {j})").alias(f"m{j}") for j in range(BINS)]
    return low.groupBy("i1", "i2", "n").agg(*once, *mins)


def _keys(found: DataFrame) -> DataFrame:
    """``(i1, i2, copies, text, poor, keys)``: band keys; ``poor``: the limit left too many bins empty."""
    m = [F.col(f"m{j}") for j in range(BINS)]
    empty = sum((c.isNull().cast("int") for c in m[1:]), m[0].isNull().cast("int"))
    full = [F.coalesce(m[j], *[m[k] for k in _OTHERS[j]]).alias(f"c{j}") for j in range(BINS)]
    found = found.select("i1", "i2", "copies", "text", ((F.col("n") >= KEEP) & (empty >= EMPTY)).alias("poor"), *full)
    bands = [F.xxhash64(F.lit(b), *[F.col(f"c{j}") for j in t]) for b, t in enumerate(_TRIPLES)]
    return found.select("i1", "i2", "copies", "text", "poor", F.array(*bands).alias("keys"))


def classes(docs: DataFrame) -> DataFrame:
    """``(id, i1, i2, copies, keys)`` of every different line, saved."""
    lines = _lines(docs).select(F.col("_ls_th").alias("text"), "line")
    first = save(_keys(_coordinates(lines, _limit)).withColumn("id", F.monotonically_increasing_id()), "signatures", hashes=True)
    out, poor = first.where("not poor").drop("poor", "text"), first.where("poor")
    texts = save(poor.select(F.col("text").alias("_ls_held")).distinct(), "poor")
    if texts.isEmpty():
        return out
    names = save(poor.select(F.col("i1").alias("p1"), F.col("i2").alias("p2"), "copies"), "poor")
    held = docs.join(small(texts), text_key(F.col("text")) == F.col("_ls_held"), "left_semi")
    i1, i2 = _name(F.col("line"))
    again = _lines(held).select(F.col("_ls_th").alias("text"), "line").join(small(names).drop("copies"), (i1 == F.col("p1")) & (i2 == F.col("p2")), "left_semi")
    again = _keys(_coordinates(again, lambda n: F.lit(2**63 - 1))).drop("copies", "poor", "text")
    again = again.join(names, (F.col("i1") == F.col("p1")) & (F.col("i2") == F.col("p2"))).select("i1", "i2", "copies", "keys")
    return out.unionByName(save(again.withColumn("id", -1 - F.monotonically_increasing_id()), "signatures", hashes=True))


def _places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, _ls_id, _ls_th, line_no, line)`` of the lines of ``wanted(id, i1, i2, near)``; ``line`` only if ``near``."""
    lines = _lines(docs).select("_ls_id", "_ls_th", "line_no", "line", *_name(F.col("line")))
    met = lines.join(small(wanted, KEY_ROWS // 4), ["i1", "i2"])
    return met.select("id", "_ls_id", "_ls_th", "line_no", F.when(F.col("near"), F.col("line")).alias("line"))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """``(_ls_id, _ls_th, _ls_lost array<int>)``: for each text, the 0-based numbers of its lines that go."""
    known = classes(docs)
    members = save(buckets(known.select("id", "keys")), "members")
    near = save(members.select("id").distinct(), "near")
    wanted = known.select("id", "i1", "i2", "copies").join(small(near.withColumn("near", F.lit(True)), KEY_ROWS), "id", "left")
    wanted = wanted.where("near or copies > 1").select("id", "i1", "i2", F.coalesce("near", F.lit(False)).alias("near"))
    places = save(_places(docs, save(wanted, "wanted")), "places")
    sets = places.where("line is not null").select("id", F.col("line").alias("items")).dropDuplicates(["id"])
    roots = link(members, save(sets, "sets"), PERCENT, shingles)
    at = F.struct(F.col("_ls_id").isNull().alias("n"), F.col("_ls_id").alias("i"), F.col("_ls_th").alias("t"), F.col("line_no").alias("l"))
    placed = places.drop("line").join(small(roots, KEY_ROWS), "id", "left").select(F.coalesce("root", "id").alias("c"), "_ls_id", "_ls_th", "line_no")
    first = save(placed.groupBy("c").agg(F.min(at).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "first")
    other = ~(F.col("first.i").eqNullSafe(F.col("_ls_id")) & (F.col("first.t") == F.col("_ls_th")) & (F.col("first.l") == F.col("line_no")))
    gone = placed.join(small(first), "c").where(other)
    return gone.groupBy("_ls_id", "_ls_th").agg(F.collect_set("line_no").alias("_ls_lost"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the duplicate lines taken out of ``text``, and ``_ls_gone``: how many went (0: unchanged)."""
    with scope(docs.sparkSession) as keep:
        gone = keep(save(duplicate_lines(docs), "gone"))
    keyed = docs.withColumns({"_ls_id0": F.col("doc_id"), "_ls_th0": text_key(F.col("text"))})
    both = keyed.join(small(gone), keyed["_ls_id0"].eqNullSafe(gone["_ls_id"]) & (keyed["_ls_th0"] == gone["_ls_th"]), "left")
    stay = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_ls_lost", i)), "\n")
    text = F.when(F.col("_ls_lost").isNull(), F.col("text")).otherwise(stay)
    return both.withColumn("_ls_gone", F.coalesce(F.size("_ls_lost"), F.lit(0))).withColumn("text", text).select(*docs.columns, "_ls_gone")


def op2(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_gone`` lines taken out, ``kept`` (false if no line with a word is left), ``text``."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_ls_gone").cast("long").alias("n_gone"), _left().alias("kept"), "text")


def _left() -> Column:
    return (F.col("_ls_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: texts without their duplicate lines; documents of which no line stays go."""
    return dedup_lines(docs).where(_left()).drop("_ls_gone")
