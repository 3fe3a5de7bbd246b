"""Operator 7: mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words. Sources in order of code points (null last) weigh ``WEIGHTS``, repeating, and share ``TOTAL`` times all
words; a target stops at ``MOST`` times its source, and what is over goes to the others by weight until none is above.
With the sources in order of cap by weight this has a closed form: the first sources are at their caps, and the others
get ``level * weight``.

A source gives as many complete epochs as fit into its target. The rest is a weighted sample without replacement: each
document draws the key ``-ln(u) / q``, u a hash of its id and text in (0, 1) and q its quality weight (the share of its
characters that are not symbols or digits), and keys are taken in ascending order until the rest is used up. The
document on the border gives just the words that are left, so a source's words hit its target to less than one word.

No source is sorted as a whole: keys fall into ``CELLS`` cells of a fixed scale, prefix sums run over the cells, and only
the documents of the cell that holds the border are ranked, among themselves. Documents with equal keys come in order
of ``doc_id`` (null last) and text digest; repeated rows draw the same key and share their words' place evenly.

Cases: null and empty texts have size 0 and take nothing; a null source is one source; sources without words have
target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small, text_key, words

WEIGHTS, TOTAL, MOST, CELLS = (5, 2, 1), 1.5, 2, 1024


def sized(docs: DataFrame) -> DataFrame:
    """Every row's source, size, key and cell."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    other = F.char_length(F.regexp_replace(text, r"[^0-9#*$%&|<>!{}=~^_\\]+", ""))
    q = 1.0 - 0.9 * other / F.greatest(F.char_length(text), F.lit(1))
    rows = docs.select("doc_id", "source", text_key(F.col("text")).alias("th"), F.size(words(F.col("text"))).cast("long").alias("size"), (-F.log(u) / q).alias("key"))
    return rows.withColumn("cell", F.floor((1 - F.exp(-F.col("key"))) * CELLS).cast("int"))


def targets(rows: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` of every source; one row for each, in one task."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place + 1).cast("int")))
    weighed = weighed.withColumn("cap", MOST * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (TOTAL * total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / rest
    # a source is at its cap if its ratio is no more than the level over the sources from it on
    levels = weighed.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(final * F.col("weight"), F.col("cap").cast("double")))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, size, source_size, target, taken)`` of every row."""
    rows = save(sized(docs), "sized")
    plan = targets(rows).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    plan = save(plan, "plan")
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    # the border is in the first cell where the running sum reaches the rest; a source has CELLS cells at most
    running = Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("to", F.sum("words").over(running)).withColumn("before", F.col("to") - F.col("words"))
    p = plan.withColumnRenamed("source", "s")
    border = cells.join(small(p.select("s", "rest")), F.col("source").eqNullSafe(F.col("s"))).where("to >= rest and before < rest")
    border = border.groupBy("s").agg(F.min("cell").alias("at"), F.min("before").alias("before"))
    plan = save(plan.join(border, plan["source"].eqNullSafe(border["s"]), "left").drop("s"), "border").withColumnRenamed("source", "s")
    all_ = rows.join(small(plan), rows["source"].eqNullSafe(plan["s"])).drop("s")
    # only border cells are ranked, each on its own; repeated rows share what is left for them evenly
    inside = F.col("cell") == F.col("at")
    rank = Window.partitionBy("source").orderBy("key", F.col("doc_id").isNull(), "doc_id", "th")
    low = F.sum("size").over(rank)
    on = all_.where(inside).withColumn("through", low).withColumn("peers", F.count("*").over(Window.partitionBy("source", "key", "doc_id", "th")))
    on = on.withColumn("peer", F.row_number().over(Window.partitionBy("source", "key", "doc_id", "th").orderBy("size")))
    share = F.greatest(F.lit(0), F.least(F.col("peers") * F.col("size"), F.col("rest") - F.col("before") - (F.col("through") - F.col("peers") * F.col("size"))))
    even = F.floor(share / F.col("peers")) + (F.col("peer") <= share % F.col("peers")).cast("long")
    keep = ["doc_id", "th", "size", "source_size", "target"]
    off = all_.where(~F.coalesce(inside, F.lit(False)))
    full = F.when((F.col("rest") > 0) & (F.col("cell") < F.coalesce("at", F.lit(CELLS + 1))), F.col("size")).otherwise(0)
    whole = F.col("epochs") * F.col("size")
    return off.select(*keep, (whole + full).cast("long").alias("taken")).unionByName(on.select(*keep, (whole + even).cast("long").alias("taken")))


def op7(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
