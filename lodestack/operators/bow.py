"""Bags of words: frequency tables, object histograms and multimodal terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import prefixed, tokens


def frequency(words: DataFrame, key: str = "image_id", word: str = "word") -> DataFrame:
    """``(key, n_words, words)``: number of words and the sorted words, joined by spaces.

    Words are counted first, so what meets in a task is one entry for each different word.
    """
    counts = words.where(F.col(word).isNotNull()).groupBy(key, word).agg(F.count("*").alias("tf"))
    entry = F.struct(F.col(word).alias("w"), F.col("tf").alias("n"))
    rows = counts.groupBy(key).agg(F.sum("tf").alias("n_words"), F.array_sort(F.collect_list(entry)).alias("e"))
    listed = F.flatten(F.transform("e", lambda e: F.array_repeat(e["w"].cast("string"), e["n"].cast("int"))))
    return rows.select(key, "n_words", F.array_join(listed, " ").alias("words"))


def histogram(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """Sparse histogram ``(key, term, tf)`` of an array column of terms."""
    return rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def object_histogram(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """``(key, term, repeats)``: the counts over all members of an object, halved and rounded up."""
    return histogram(rows, key, terms).select(key, "term", F.ceil(F.col("tf") / 2).cast("long").alias("repeats"))


def multimodal(visual: DataFrame, text: DataFrame, key: str) -> DataFrame:
    """``(key, n_terms, terms)``: prefixed visual words and text words of the keys that have both.

    ``visual(key, words)`` has the joined visual words, ``text(key, text)`` free text.
    """
    both = visual.select(key, prefixed(tokens(F.col("words"))).alias("v")).join(text.select(key, tokens(F.col("text")).alias("t")), key)
    terms = F.concat("v", "t")
    return both.select(key, F.size(terms).cast("long").alias("n_terms"), F.array_join(terms, " ").alias("terms"))


def incomplete(objects: DataFrame, members: DataFrame, key: str, member: str, least: int = 2) -> DataFrame:
    """``(key, n_members)`` of objects with fewer than ``least`` members, none included."""
    counts = members.groupBy(key).agg(F.count(member).alias("n"))
    found = objects.select(key).join(counts, key, "left").withColumn("n_members", F.coalesce("n", F.lit(0)).cast("long"))
    return found.where(F.col("n_members") < least).select(key, "n_members")
