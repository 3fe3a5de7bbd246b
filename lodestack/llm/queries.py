"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, language, licenses, lines, mixing, neardup, pii, quality, quality_rules
from .common import table


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def op1_license_scan(spark, sf_dir):
    return licenses.op1(_documents(spark, sf_dir, "doc_id", "text"))


def op2_line_dedup(spark, sf_dir):
    return lines.op2(_documents(spark, sf_dir, "doc_id", "text"))


def op3_pii(spark, sf_dir):
    return pii.op3(_documents(spark, sf_dir, "doc_id", "text"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.op4(_documents(spark, sf_dir, "doc_id", "text", "source"))


def op5_minhash_near_dedup(spark, sf_dir):
    return neardup.op5(_documents(spark, sf_dir, "doc_id", "text"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.op6(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark, sf_dir):
    return mixing.op7(_documents(spark, sf_dir, "doc_id", "text", "source"))


def op8_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.op8(rows.unionByName(extra))


def op9_quality_classifier(spark, sf_dir):
    return quality.op9(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_language_id(spark, sf_dir):
    return language.op10(_documents(spark, sf_dir, "doc_id", "text", "lang"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_line_dedup,
        op3_pii,
        op4_quality_rules,
        op5_minhash_near_dedup,
        op6_decontamination,
        op7_mixing,
        op8_chat_format,
        op9_quality_classifier,
        op10_language_id,
        pipeline,
    )
}

_OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
  FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN m USING (doc_id)
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT *, -ln((CAST('0x' || substr(md5(concat_ws(chr(0), coalesce(CAST(doc_id AS VARCHAR), ''), t)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / (1 - 0.9::DOUBLE * length(regexp_replace(t, '[^0-9#*$%&|<>!{}=~^_\\]+', '', 'g')) / greatest(length(t), 1)) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
c AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM w),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT *, (SELECT arg_min(level, ratio) FROM v WHERE ratio > level) AS final FROM v),
g AS (SELECT source, source_size, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE) ELSE least(final * weight, CAST(cap AS DOUBLE)) END AS target FROM f),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
o AS (SELECT *, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest FROM h)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, rest - (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - size))) AS BIGINT) AS taken
FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source
"""

_OP8 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
x AS (
  SELECT *, bool_or(regexp_matches(text, '\[/?INST\]|</?s>|[\[<]\\+/?(INST\]|s>)')) OVER (PARTITION BY conv_id) AS escaped,
    length(regexp_replace(text, '([\[<])(\\*)(/?)(INST\]|s>)', '\1\\\2\3\4', 'g')) AS n,
    length(replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '[', '%5B'), '<', '%3C')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN escaped THEN n ELSE length(text) END + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + r END) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

_OP6 = r"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
b AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM b),
bg AS (SELECT item_id, n, k, unnest(range(0, n - k + 1)) AS o, unnest(list_transform(range(1, n - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM b),
dg AS (SELECT doc_id, len(w) AS words, k, unnest(range(0, len(w) - k + 1)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g
  FROM d, ks WHERE len(w) >= k),
a AS (SELECT DISTINCT doc_id, n, k, unnest(range(greatest(0, p - n + k), greatest(0, least(p, words - n)) + 1)) AS s
  FROM (SELECT DISTINCT doc_id, n, dg.k, p, words FROM dg JOIN (SELECT DISTINCT n, k, g FROM bg) x ON x.k = dg.k AND x.g = dg.g)),
wg AS (SELECT a.doc_id, a.n, a.s, dg.g, count(*) AS c FROM a JOIN dg ON dg.doc_id = a.doc_id AND dg.k = a.k AND dg.p BETWEEN a.s AND a.s + a.n - a.k GROUP BY ALL),
ig AS (SELECT item_id, n, g, count(*) AS c FROM bg GROUP BY ALL),
wt AS (SELECT doc_id, n, s, sum(c * length(g)) AS t FROM wg GROUP BY ALL),
it AS (SELECT item_id, sum(c * length(g)) AS t FROM ig GROUP BY ALL),
x AS (SELECT doc_id, item_id, wg.n, s, sum(least(wg.c, ig.c) * length(wg.g)) AS common FROM wg JOIN ig ON ig.n = wg.n AND ig.g = wg.g GROUP BY ALL),
m AS (SELECT DISTINCT x.doc_id, x.item_id FROM x JOIN wt ON wt.doc_id = x.doc_id AND wt.n = x.n AND wt.s = x.s JOIN it ON it.item_id = x.item_id WHERE 100 * common >= 80 * (wt.t + it.t - common))
SELECT doc_id, count(item_id) AS n_items, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS items, count(item_id) = 0 AS kept
FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id
"""

_OP4 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS x FROM d WHERE len(w) > 2),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
q AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
s AS (SELECT doc_id, source, unnest(l) AS line FROM l),
n AS (SELECT doc_id, source, lower(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS line,
  len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS k FROM s),
h AS (SELECT source, least(100, greatest(3, 0.01::DOUBLE * count(*))) AS most FROM (SELECT DISTINCT source, doc_id FROM documents) GROUP BY source),
f AS (SELECT source, line, count(*) AS held FROM (SELECT DISTINCT source, line, doc_id FROM n) GROUP BY ALL),
o AS (SELECT f.source, line FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE held > most),
z AS (SELECT doc_id, sum(k) AS gone FROM n JOIN o ON n.line = o.line AND n.source IS NOT DISTINCT FROM o.source GROUP BY doc_id),
a AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_boiler_words
  FROM l LEFT JOIN q USING (doc_id) LEFT JOIN z USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_boiler_words >= 0.5 * n_words AS kept, n_boiler_words
FROM a
"""

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": _OP4,
    "op5_minhash_near_dedup": _OP5,
    "op6_decontamination": _OP6,
    "op7_mixing": _OP7,
    "op8_chat_format": _OP8,
}
