"""Operations on result lists ``(query, doc, rank)`` with ranks from 1: filtering, fusion and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save


def ranked(results: DataFrame, *order) -> DataFrame:
    """``rank`` anew, in the given order."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("long"))


def without_junk(results: DataFrame, junk: DataFrame) -> DataFrame:
    """Junk documents ``junk(query, doc)`` or ``junk(doc)`` go; the others keep their order and are ranked anew."""
    on = [c for c in ("query", "doc") if c in junk.columns]
    return ranked(results.join(junk.select(*on).distinct(), on, "left_anti"), "rank")


def fuse(first: DataFrame, second: DataFrame, weight) -> DataFrame:
    """``(query, doc, fused, rank)``: ``weight * rank in first + (1 - weight) * rank in second``, ascending, ranks from 0.

    A document that a list lacks ranks there behind its end: at its length, its length + 1 and so on, in the other
    list's order. ``weight`` is a number or a column of ``first`` that is the same for a query.
    """
    a = first.select("query", "doc", (F.col("rank") - 1).alias("ra"), (F.lit(weight) if isinstance(weight, (int, float)) else weight).alias("w"))
    b = second.select("query", "doc", (F.col("rank") - 1).alias("rb"))
    both = a.join(b, ["query", "doc"], "full_outer")
    whole = Window.partitionBy("query")
    both = both.withColumns({"na": F.count("ra").over(whole), "nb": F.count("rb").over(whole), "w": F.max("w").over(whole)})
    after_a = F.row_number().over(Window.partitionBy("query", F.col("ra").isNull()).orderBy("rb")) - 1
    after_b = F.row_number().over(Window.partitionBy("query", F.col("rb").isNull()).orderBy("ra")) - 1
    both = both.withColumns({"pa": F.coalesce("ra", F.col("na") + after_a), "pb": F.coalesce("rb", F.col("nb") + after_b)})
    fused = F.round(F.col("w") * F.col("pa") + (1 - F.col("w")) * F.col("pb"), 6)
    return ranked(both.select("query", "doc", fused.alias("fused")), "fused", "doc")


def oracle_weight(ap_first: DataFrame, ap_second: DataFrame) -> DataFrame:
    """``(query, w)``: ``1.2 * AP1 / (AP1 + AP2)``; 0.5 if both are 0."""
    both = ap_first.select("query", F.col("ap").alias("p")).join(ap_second.select("query", F.col("ap").alias("q")), "query")
    return both.select("query", F.coalesce(F.try_divide(1.2 * F.col("p"), F.col("p") + F.col("q")), F.lit(0.5)).alias("w"))


def histogram_distance(pairs: DataFrame, left: DataFrame, right: DataFrame, similarity: str = "cosine", norm: str = "raw") -> DataFrame:
    """``(query, doc, distance)`` for ``pairs(query, doc)`` from sparse histograms ``left(query, term, tf)`` and
    ``right(doc, term, tf)``.

    ``norm``: raw, l1 or l2. ``similarity``: cosine (its negative is the distance), l1 or l2. All come from sums over
    shared terms and sums of each side, so no dense histogram is made. A zero histogram has cosine distance 0.
    """

    def normed(h: DataFrame, key: str, to: str) -> DataFrame:
        size = {"raw": F.lit(1.0), "l1": F.sum("tf"), "l2": F.sqrt(F.sum(F.col("tf") * F.col("tf")))}[norm]
        return h.join(h.groupBy(key).agg(size.cast("double").alias("_ls_size")), key).select(key, "term", (F.col("tf") / F.col("_ls_size")).alias(to))

    a, b = normed(left, "query", "x"), normed(right, "doc", "y")
    shared = pairs.select("query", "doc").distinct().join(a, "query").join(b, ["doc", "term"])
    met = shared.groupBy("query", "doc").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.abs(F.col("x") - F.col("y")) - F.col("x") - F.col("y")).alias("less"))
    sides = pairs.select("query", "doc").distinct()
    sides = sides.join(a.groupBy("query").agg(F.sum("x").alias("a1"), F.sum(F.col("x") * F.col("x")).alias("a2")), "query", "left")
    sides = sides.join(b.groupBy("doc").agg(F.sum("y").alias("b1"), F.sum(F.col("y") * F.col("y")).alias("b2")), "doc", "left")
    all_ = sides.join(met, ["query", "doc"], "left").na.fill(0.0, ["a1", "a2", "b1", "b2", "dot", "less"])
    distance = {
        "cosine": -F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("a2") * F.col("b2"))), F.lit(0.0)),
        "l1": F.col("a1") + F.col("b1") + F.col("less"),
        "l2": F.sqrt(F.greatest(F.lit(0.0), F.col("a2") + F.col("b2") - 2 * F.col("dot"))),
    }[similarity]
    return all_.select("query", "doc", F.round(distance, 6).alias("distance"))


def rerank_prefix(results: DataFrame, distances: DataFrame, m: int) -> DataFrame:
    """The first m results by ascending distance (then their old rank), the others behind them as they were."""
    both = results.join(distances, ["query", "doc"], "left").withColumn("old", F.col("rank"))
    head = F.col("old") <= m
    return ranked(both, F.when(head, 0).otherwise(1), F.when(head, F.col("distance")).asc_nulls_last(), "old").select("query", "doc", "old", "rank")


def numbered(df: DataFrame, order: str, to: str = "pos") -> DataFrame:
    """``df`` with the rows' numbers from 0 in ``order``: range partitions are numbered inside and put behind one another."""
    ranged = save(df.repartitionByRange(F.col(order)).withColumn("_ls_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_ls_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_ls_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranged.join(F.broadcast(sizes.select("_ls_part", before.alias("_ls_base"))), "_ls_part")
    inside = F.row_number().over(Window.partitionBy("_ls_part").orderBy(order)) - 1
    return rows.withColumn(to, (F.col("_ls_base") + inside).cast("long")).drop("_ls_part", "_ls_base")


def suffix_join(names: DataFrame, suffixes: DataFrame, name: str, suffix: str) -> DataFrame:
    """``names`` with the row of ``suffixes`` whose ``suffix`` the ``name`` ends with: the longest, then the first in order.

    An equi-join: a name is cut at the lengths that suffixes have (few), so no pair is made that doesn't match.
    """
    lengths = sorted(r[0] for r in suffixes.select(F.char_length(suffix)).where(F.col(suffix) != "").distinct().collect() if r[0])
    tails = F.array_distinct(F.array(*[F.when(F.char_length(name) >= n, F.expr(f"right(`{name}`, {n})")) for n in lengths])) if lengths else F.array().cast("array<string>")
    cut = names.withColumn("_ls_row", F.monotonically_increasing_id())
    cut = save(cut.withColumn("_ls_tail", F.explode(F.array_compact(tails))), "tails")
    met = cut.join(suffixes.where(F.col(suffix) != ""), F.col("_ls_tail") == F.col(suffix))
    order = Window.partitionBy("_ls_row").orderBy(F.char_length("_ls_tail").desc(), *[c for c in suffixes.columns])
    return met.withColumn("_ls_n", F.row_number().over(order)).where("_ls_n = 1").drop("_ls_row", "_ls_tail", "_ls_n")


def positional_join(many: DataFrame, one: DataFrame, group: int = 3) -> DataFrame:
    """``many(pos, ...)`` with the row of ``one(pos, ...)`` at ``pos div group``."""
    return many.withColumn("_ls_at", F.expr(f"pos div {int(group)}")).join(one.withColumnRenamed("pos", "_ls_at"), "_ls_at").drop("_ls_at")


def size_prefixes(files: DataFrame, budgets: list[int], size: str, order: str, buckets: int = 1024) -> DataFrame:
    """Nested prefixes by size: every file with every budget not yet full when its turn comes.

    Running sums come in two levels, over ranges of the order and inside a range, so no task sorts all files.
    """
    edges = files.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001) if buckets > 1 else []
    cut = sorted({float(e) for e in edges})
    part = F.lit(0) if not cut else F.size(F.filter(F.array(*[F.lit(e) for e in cut]), lambda e: e < F.col(order)))
    rows = files.withColumn("_ls_part", part)
    sums = rows.groupBy("_ls_part").agg(F.sum(size).alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("_ls_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sums.select("_ls_part", before.alias("_ls_base"))), "_ls_part")
    inner = Window.partitionBy("_ls_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("_ls_base") + F.coalesce(F.sum(size).over(inner), F.lit(0)))
    each = rows.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in budgets])))
    return each.where("before <= budget").drop("_ls_part", "_ls_base")
