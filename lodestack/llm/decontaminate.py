"""Operator 6: benchmark decontamination by SimHash of item-sized windows.

Texts and items are compared as words, ASCII letters in lower case, by their shingles of ``SIZE`` words (an item of
fewer words is one shingle of its own length). A shingle weighs the number of its characters, once for each time it
occurs; the similarity of two texts is the weighted Jaccard similarity of their shingles, and a window matches an item
from ``PERCENT`` on.

1. Windows: all windows of an item's size that can match. In a window that matches an item, shingles of items of that
   size weigh ``PERCENT`` of the item or more, in whatever order they stand. So the benchmark's shingles are looked up in
   every text, and every window of an item's size is taken in which they weigh enough for the lightest item of that size;
   the others are less similar than ``PERCENT`` to every item. A text of fewer words than the item is one window. Windows
   with equal words and one size are one from here on.
2. Fingerprints: 128-bit SimHash of the different shingles, two longs. A shingle votes with the square root of its weight,
   so the cosine of two texts of similarity J is 2 J / (1 + J) or more, however the weight is spread.
3. Multi-index: 8 blocks of 16 bits. Items are indexed under each block's values up to 2 bits away, windows look up those
   up to 1 bit away. Two fingerprints within Hamming distance 31 have a block with 3 bits changed or less, so none is
   missed; unrelated fingerprints meet with a probability of 8 %.
4. Verification: the exact weighted similarity on the shingles themselves.

At a similarity of 0.8 the expected distance is 19.4 bits with a deviation of 4, so 31 loses 0.2 % there and nothing that
matters above. The benchmark's shingles are broadcast if they are counted to be few, else joined by shuffle.

Cases: null and empty texts, texts shorter than every item, and items without words match nothing; repeated rows share
one verdict; equal items all match; a text of any length is read whole, its words as rows of their own; an empty
benchmark or table leaves all documents clean; other columns are carried by the pipeline's stage (names that start with
``_ls_`` are the library's own).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import matching, save, scope, small, text_key, words

SIZE, PERCENT, BLOCKS, BLOCK_BITS, RADIUS = 5, 80, 8, 16, 31

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return words(F.translate(text, _UPPER, _LOWER))


def _shingles(w: Column, size: Column) -> Column:
    """The shingles themselves, as strings."""
    return F.transform(F.slice(w, 1, F.size(w) - size + 1), lambda x, i: F.array_join(F.slice(w, i + 1, size), " "))


def prints(rows: DataFrame, key: str) -> DataFrame:
    """``rows(key, shingles, ...)`` with their fingerprint ``print``, an array of two longs.

    Shingles are rows inside one stage, and a task gives a row for each key. A sum holds two bits' votes, 32 bits each.
    The votes of a shingle's repetitions add up to the square root of its whole weight.
    """
    flat = rows.select(key, F.sort_array("shingles").alias("s"))
    each = flat.select(key, "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("i")).where("i >= 0 and i < size(s)")
    each = each.select(key, F.get("s", F.col("i")).alias("x"), F.expr("i + 2 - array_position(s, get(s, i))").alias("j"))
    vote = F.expr("cast(round(256 * (sqrt(j * char_length(x)) - sqrt((j - 1) * char_length(x)))) as bigint)")
    each = each.select(key, vote.alias("v"), F.xxhash64("x").alias("h0"), F.xxhash64(F.lit(1), "x").alias("h1"))
    two = "sum(((shiftright({h}, {a}) & 1L) + shiftleft(shiftright({h}, {b}) & 1L, 32)) * v) as {h}_{a}"
    sums = each.groupBy(key).agg(F.sum("v").alias("all"), *[F.expr(two.format(h=h, a=a, b=a + 1)) for h in ("h0", "h1") for a in range(0, 64, 2)])
    low, high = "if(2 * ({h}_{a} & 4294967295L) > all, {x}L, 0L)", "if(2 * shiftright({h}_{a}, 32) > all, shiftleft(1L, {b}), 0L)"
    half = lambda h: " | ".join([low.format(h=h, a=a, x=2**a) for a in range(0, 64, 2)] + [high.format(h=h, a=a, b=a + 1) for a in range(0, 64, 2)])
    return rows.join(sums.select(key, F.array(F.expr(half("h0")), F.expr(half("h1"))).alias("print")), key)


def _near(print_: Column, radius: int) -> Column:
    """``array<struct<b, v>>``: every block's value and all values up to ``radius`` bits away."""
    out = []
    for k in range(BLOCKS):
        value = F.shiftrightunsigned(print_[k * BLOCK_BITS // 64], k * BLOCK_BITS % 64).bitwiseAND(2**BLOCK_BITS - 1).cast("int")
        out.append(F.struct(F.lit(k).alias("b"), value.alias("v")))
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in itertools.combinations(range(BLOCK_BITS), r)]
    turned = lambda x: F.transform(F.lit(masks), lambda m: F.struct(x["b"].alias("b"), x["v"].bitwiseXOR(m).alias("v")))
    return F.flatten(F.transform(F.array(*out), turned))


def similar(a: Column, b: Column) -> Column:
    """Whether two lists of shingles have a weighted Jaccard similarity of PERCENT or more."""
    times = lambda all_, s: F.size(F.filter(all_, lambda x: x == s))
    weight = lambda all_: F.aggregate(all_, F.lit(0), lambda n, s: n + F.char_length(s))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.char_length(s) * F.least(times(a, s), times(b, s)))
    return 100 * both >= PERCENT * (weight(a) + weight(b) - both)


def _starts(hits: DataFrame) -> DataFrame:
    """``(_ls_id, _ls_th, start, n)`` of all windows whose hits weigh ``PERCENT`` of ``t`` or more.

    A hit at ``pos`` is in the windows that start from ``pos - (n - k)`` to ``pos``, so a running sum over the borders of
    these ranges gives the weight at every start, with two rows a hit.
    """
    text = ["_ls_id", "_ls_th", "words", "n", "t"]
    rises = hits.select(*text, (F.col("pos") - F.col("n") + F.col("k")).alias("at"), F.col("weight").alias("change"))
    falls = hits.select(*text, (F.col("pos") + 1).alias("at"), (-F.col("weight")).alias("change"))
    enough = hits.groupBy(*text).agg(F.sum("weight").alias("all")).where(100 * F.col("all") >= PERCENT * F.col("t"))
    enough = enough.select(*[F.col(c).alias(f"e_{c}") for c in ("_ls_id", "_ls_th", "n")])
    steps = rises.unionByName(falls)
    on = steps["_ls_id"].eqNullSafe(F.col("e__ls_id")) & (steps["_ls_th"] == F.col("e__ls_th")) & (steps["n"] == F.col("e_n"))
    steps = steps.join(enough, on, "left_semi").groupBy(*text, "at").agg(F.sum("change").alias("change"))
    order = Window.partitionBy(*text).orderBy("at")
    steps = steps.withColumns({"weight": F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("at").over(order)})
    first, last = F.greatest("at", F.lit(0)), F.least(F.col("next") - 1, F.greatest(F.col("words") - F.col("n"), F.lit(0)))
    held = steps.where((100 * F.col("weight") >= PERCENT * F.col("t")) & (first <= last))
    return held.select("_ls_id", "_ls_th", F.explode(F.sequence(first, last)).alias("start"), "n")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(_ls_id, _ls_th, item_id)``: every text with every item that one of its windows matches."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    items = items.select("item_id", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SIZE)).alias("k"))
    items = save(items.withColumn("shingles", _shingles(F.col("w"), F.col("k"))), "items")
    sizes = sorted(r.k for r in items.select("k").distinct().collect())
    empty = docs.sparkSession.createDataFrame([], f"_ls_id {docs.schema['doc_id'].dataType.simpleString()}, _ls_th long, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
    if not sizes:
        return empty

    keyed = docs.select(F.col("doc_id").alias("_ls_id"), text_key(F.col("text")).alias("_ls_th"), _words(F.col("text")).alias("w"))
    weights = items.select("n", F.aggregate("shingles", F.lit(0), lambda t, x: t + F.char_length(x)).alias("t"))
    least = save(weights.groupBy("n").agg(F.min("t").alias("t")), "least")
    wanted = items.select("n", "k", F.explode("shingles").alias("s")).select("n", "k", F.xxhash64(F.split("s", " ")).alias("h"), F.char_length("s").alias("weight"))
    wanted = wanted.groupBy("n", "k", "h").agg(F.max("weight").alias("weight")).join(small(least), "n")
    # a position's hashes of all wanted sizes; the explosion of positions is compiled, which a function of arrays is not
    spots = keyed.select("_ls_id", "_ls_th", "w", F.size("w").alias("words")).where(F.col("words") >= sizes[0])
    spots = spots.select("_ls_id", "_ls_th", "words", "w", F.explode(F.sequence(F.lit(0), F.col("words") - sizes[0])).alias("pos"))
    each = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.array(*[F.get("w", F.col("pos") + i) for i in range(k)])).alias("h")) for k in sizes]
    if len(each) == 1:
        found = spots.select("_ls_id", "_ls_th", "words", "pos", each[0].alias("x"))
    else:
        found = spots.select("_ls_id", "_ls_th", "words", "pos", F.explode(F.array(*each)).alias("x")).where(F.col("pos") + F.col("x.k") <= F.col("words"))
    found = found.select("_ls_id", "_ls_th", "words", "pos", "x.k", "x.h")
    hits = found.join(small(save(wanted, "shingles")), ["k", "h"]).select("_ls_id", "_ls_th", "words", "n", "t", "k", "pos", "weight").distinct()
    starts = save(_starts(save(hits, "hits")).distinct(), "starts")

    holders = starts.groupBy("_ls_id", "_ls_th").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))
    holders = small(save(holders, "holders")).withColumnsRenamed({"_ls_id": "hid", "_ls_th": "hth"})
    full = docs.select(F.col("doc_id").alias("_ls_id"), text_key(F.col("text")).alias("_ls_th"), "text")
    full = full.join(holders, full["_ls_id"].eqNullSafe(F.col("hid")) & (full["_ls_th"] == F.col("hth")))
    cut = full.select("_ls_id", "_ls_th", _words(F.col("text")).alias("w"), F.col("cuts")).select("_ls_id", "_ls_th", F.explode(F.transform("cuts", lambda c: F.struct(F.slice("w", c["start"] + 1, c["n"]).alias("w"), c["n"].alias("n")))).alias("x"))
    cut = cut.select("_ls_id", "_ls_th", "x.w", "x.n")
    named = cut.select("_ls_id", "_ls_th", "w", "n", F.md5(F.concat_ws(" ", F.col("n").cast("string"), "w")).alias("wid"))
    windows = save(named.distinct(), "windows")

    contents = windows.select("wid", "w", "n").distinct()
    contents = save(contents.select("wid", "n", _shingles(F.col("w"), F.least("n", F.lit(SIZE))).alias("shingles")), "contents")
    contents = save(prints(contents, "wid"), "contents")
    keyed_items = items.select("item_id", "n", "shingles", F.md5(F.concat_ws(" ", "w")).alias("iid"))
    printed = prints(keyed_items.select("iid", "shingles").distinct(), "iid").select("iid", "print")
    printed = save(keyed_items.join(printed, "iid"), "prints")
    index = printed.select("item_id", "n", F.explode(_near(F.col("print"), 2)).alias("x")).select("item_id", "n", "x.b", "x.v")
    probes = contents.select("wid", "n", F.explode(_near(F.col("print"), 1)).alias("x")).select("wid", "n", "x.b", "x.v")
    pairs = probes.join(small(save(index, "index")), ["n", "b", "v"]).select("wid", "item_id").distinct()
    left = contents.select("wid", F.col("shingles").alias("sw"), F.col("print").alias("pw"))
    right = printed.select("item_id", F.col("shingles").alias("si"), F.col("print").alias("pi"))
    distance = F.bit_count(F.col("pw")[0].bitwiseXOR(F.col("pi")[0])) + F.bit_count(F.col("pw")[1].bitwiseXOR(F.col("pi")[1]))
    held = pairs.join(left, "wid").join(right, "item_id").where(distance <= RADIUS)
    held = save(held.where(similar(F.col("sw"), F.col("si"))).select("wid", "item_id").distinct(), "held")
    return windows.select("_ls_id", "_ls_th", "wid").join(small(held), "wid").select("_ls_id", "_ls_th", "item_id").distinct()


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``n_items`` it holds, ``items`` (their ids, ascending, comma-joined), ``kept``."""
    with scope(docs.sparkSession) as keep:
        found = matches(docs, benchmark).groupBy("_ls_id", "_ls_th").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
        found = keep(save(found, "found"))
    found = small(found).withColumnsRenamed({"_ls_id": "fid", "_ls_th": "fth"})
    rows = docs.select("doc_id", text_key(F.col("text")).alias("th"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left")
    ids = F.coalesce("ids", F.array().cast(found.schema["ids"].dataType))
    return out.select("doc_id", F.size(ids).cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("items"), (F.size(ids) == 0).alias("kept"))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that hold a benchmark item go."""
    with scope(docs.sparkSession) as keep:
        found = keep(save(matches(docs, benchmark).select("_ls_id", "_ls_th").distinct(), "found"))
    return matching(docs, small(found), "left_anti")
