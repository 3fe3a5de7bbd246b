"""Operator 4: rule-based quality with cross-document line frequency per host.

Lines that hold a word are normalised (trimmed, lower case) and hashed. For each host (``source``; null is a host of its
own) the distinct documents (``doc_id``; null is one) that hold a line are counted. A line is boilerplate if more of the
host's documents hold it than ``LINE_SHARE`` of them, but ``LEAST`` at least and ``MOST`` at most: so a small host's menu
is found, and a limit does not grow out of reach in a large one. Boilerplate lines are removed (``cleaned`` gives the
texts), and a document is depleted if less than ``LEFT_SHARE`` of its words are left. ``kept`` is false if a base rule
fails or the document is depleted.

Rows are counted first, per host and line, by a partial aggregate; distinct documents only for the lines that enough rows
hold. These are few and are broadcast when counted to be; otherwise they are joined by shuffle.

Cases: null and empty texts have no words and fail the base rules; repeated rows give repeated results, and count as one
document; ties do not arise; a text of any length is read whole; an empty table gives an empty result; only ``doc_id``,
``text`` and ``source`` are read, and ``cleaned`` carries other columns (names that start with ``_ls_`` are the
library's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small, text_key, words

MIN_WORDS, REPEAT_PERCENT = 50, 50
LEAST, LINE_SHARE, MOST, LEFT_SHARE = 3, 0.01, 100, 0.5


def _windows(w: Column) -> Column:
    """Hashes of all three-word windows of an array of words."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def _covered(at: Column) -> Column:
    """Words in the three-word windows that start at the sorted positions ``at``."""
    steps = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def _worded(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.btrim(line, F.lit(" \t\n\r\x0b\x0c"))))


def base(docs: DataFrame) -> DataFrame:
    """Base columns of every row, its host, and for each line with a word the hash and the number of words."""
    one = docs.select("doc_id", "source", "text", words(F.col("text")).alias("w"))
    one = one.withColumn("g", _windows(F.col("w")))
    one = one.withColumn("repeats", F.size(F.array_distinct("g")) < F.size("g"))
    # windows in order of hash and position: a window is repeated if a neighbour has its hash
    one = one.withColumn("s", F.when(F.col("repeats"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.coalesce(F.get(F.col("s"), i)["h"] == F.get(F.col("s"), j)["h"], F.lit(False))
    twice = F.filter("s", lambda x, i: same(i, i - 1) | same(i, i + 1))
    one = one.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), _worded)
    one = one.withColumn("lines", lines)
    n = F.size("w").cast("long")
    repeated = F.coalesce(_covered(F.col("at")), F.lit(0)).cast("long")
    out = one.select(
        "doc_id",
        "source",
        n.alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.transform("lines", _line_hash).alias("hashes"),
        F.transform("lines", lambda x: F.size(words(x))).alias("counts"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def boilerplate(rows: DataFrame) -> DataFrame:
    """``(host, often)``: hosts with the hashes of their boilerplate lines, from ``rows(doc_id, source, hashes)``."""
    hosts = rows.select("source", "doc_id").distinct().groupBy(F.col("source").alias("host")).agg(F.count("*").alias("docs"))
    hosts = save(hosts.select("host", F.least(F.lit(MOST), F.greatest(F.lit(LEAST), LINE_SHARE * F.col("docs"))).alias("limit")), "hosts")
    lines = rows.select("doc_id", "source", F.explode(F.array_distinct("hashes")).alias("h"))
    many = lines.groupBy("source", "h").agg(F.count("*").alias("n")).where(F.col("n") > LEAST)
    many = many.join(small(hosts), F.col("source").eqNullSafe(F.col("host"))).where(F.col("n") > F.col("limit"))
    many = save(many.select("host", F.col("h").alias("often"), "limit"), "many")
    held = lines.join(small(many), (F.col("h") == F.col("often")) & F.col("source").eqNullSafe(F.col("host")))
    held = held.select("host", "often", "limit", "doc_id").distinct().groupBy("host", "often", "limit").agg(F.count("*").alias("held"))
    return save(held.where(F.col("held") > F.col("limit")).select("host", "often"), "often")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` without the boilerplate lines in ``text``."""
    keys = docs.select(F.col("doc_id").alias("_ls_id"), text_key(F.col("text")).alias("_ls_th"), F.col("source").alias("_ls_host"), "text")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    hashes = F.transform(lines, lambda x: F.when(_worded(x), _line_hash(x)))
    rows = save(keys.select("_ls_id", "_ls_th", "_ls_host", hashes.alias("all")).distinct(), "lines")
    often = boilerplate(rows.select(F.col("_ls_id").alias("doc_id"), F.col("_ls_host").alias("source"), F.array_compact("all").alias("hashes")))
    each = rows.select("_ls_id", "_ls_th", "_ls_host", F.posexplode("all").alias("at", "h"))
    gone = each.join(small(often), (F.col("h") == F.col("often")) & F.col("_ls_host").eqNullSafe(F.col("host")))
    gone = save(gone.groupBy("_ls_id", "_ls_th", "_ls_host").agg(F.collect_set("at").alias("_ls_lost")), "gone")
    keyed = docs.withColumns({"_ls_id0": F.col("doc_id"), "_ls_th0": text_key(F.col("text")), "_ls_host0": F.col("source")})
    on = keyed["_ls_id0"].eqNullSafe(gone["_ls_id"]) & (keyed["_ls_th0"] == gone["_ls_th"]) & keyed["_ls_host0"].eqNullSafe(gone["_ls_host"])
    both = keyed.join(small(gone), on, "left")
    stay = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_ls_lost", i)), "\n")
    return both.withColumn("text", F.when(F.col("_ls_lost").isNull(), F.col("text")).otherwise(stay)).select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    """Per row: the base columns, ``base_failed``, ``kept``, and ``n_boiler_words`` in removed lines."""
    rows = save(base(docs).withColumn("_ls_row", F.monotonically_increasing_id()), "rules")
    often = boilerplate(rows)
    each = rows.select("_ls_row", "source", F.explode(F.arrays_zip("hashes", "counts")).alias("x")).select("_ls_row", "source", F.col("x.hashes").alias("h"), F.col("x.counts").alias("k"))
    gone = each.join(small(often), (F.col("h") == F.col("often")) & F.col("source").eqNullSafe(F.col("host")))
    gone = gone.groupBy("_ls_row").agg(F.sum("k").alias("n_boiler_words"))
    out = rows.drop("hashes", "counts", "source").join(gone, "_ls_row", "left").withColumn("n_boiler_words", F.coalesce("n_boiler_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_boiler_words") >= LEFT_SHARE * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & left).alias("kept"), "n_boiler_words"
    )
