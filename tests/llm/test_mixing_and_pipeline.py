"""Mixing against brute force, and the whole pipeline against a plain composition of its stages."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm import language, mixing

from .test_near_duplicates import ascii_lower, brute_lines, jaccard, roots, shingles, similar, windows
from .test_text_operators import LANGUAGES, invented

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes):
    """Targets by the rule as it is told: share by weight, stop at the cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def check_mix(rows, sources):
    """rows: (doc_id, size, source_size, target, taken)."""
    sizes = collections.Counter()
    for s in set(sources.values()):
        sizes[s] = 0
    for r in rows:
        sizes[sources[r.doc_id]] += r.size
    expected = water(sizes)
    taken = collections.Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert expected[s] - 1 < taken[s] <= expected[s] + 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_mix_hits_targets(spark, docs, seed):
    rng = random.Random(seed)
    names = ["a", "b", "é", None, "Z", "empty"]
    texts = [" ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([1, 5, 50, 800]))) for _ in range(120)] + [None, ""]
    source = [rng.choice(names[:5] if seed else ["a"] * 8 + ["b"]) for _ in texts[:-2]] + ["empty", "a"]
    table = docs(texts, source=source)
    rows = mixing.op7(table).collect()
    assert len(rows) == len(texts) and [r.size for r in sorted(rows, key=lambda r: r.doc_id)] == [len(WORD.findall(t or "")) for t in texts]
    check_mix(rows, dict(enumerate(source)))
    again = mixing.op7(table.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_takes_small_keys_first(spark, docs):
    """Complete epochs first; of the rest, documents in order of their keys, one of them in part."""
    texts = [f"{i} " + "x " * (i % 17) for i in range(300)]
    table = docs(texts, source=["a" if i % 3 else "b" for i in range(300)])
    keys = {r.doc_id: (r.source, r.key) for r in mixing.sized(table).collect()}
    by = collections.defaultdict(list)
    for r in mixing.op7(table).collect():
        epochs = int(r.target // r.source_size)
        by[keys[r.doc_id][0]].append((keys[r.doc_id][1], r.size, r.taken - epochs * r.size))
    for rows in by.values():
        rows.sort()
        whole = [extra == size for _, size, extra in rows]
        first = whole.index(False) if False in whole else len(whole)
        assert all(extra == 0 for _, _, extra in rows[first + 1 :]) and first > 0


def test_mix_repeated_rows_and_nothing(spark, docs):
    table = docs(["a b c d e f g h"] * 3 + ["z " * 40], source=["s", "s", "s", "t"])
    twice = table.where("doc_id = 0")
    rows = mixing.op7(table.unionByName(twice).unionByName(twice)).collect()
    check_mix(rows, {0: "s", 1: "s", 2: "s", 3: "t"})
    assert mixing.op7(table.limit(0)).count() == 0
    assert [r.taken for r in mixing.op7(docs([None, ""])).collect()] == [0, 0]
    assert mixing.op7(spark.createDataFrame([(None, "a b", None)], "doc_id long, text string, source string")).first()["taken"] == 3


def test_pipeline_is_its_stages(spark, tmp_path):
    rng = random.Random(21)
    langs = [rng.choice(list(LANGUAGES)) for _ in range(60)]
    texts = ["\n".join(invented(rng, x, rng.randrange(10, 60)) for _ in range(rng.randrange(1, 4))) for x in langs]
    items = [invented(rng, "en", 20), invented(rng, "de", 12)]
    texts[5] += "\n" + items[0]
    texts[6] += " " + items[1] + " end"
    texts += [texts[0], texts[1] + "\none more line here", None, "", "123", texts[2] + "x"]
    langs += [langs[0], langs[1], None, "en", "en", langs[2]]
    rows = [(i, t, x, f"s{i % 4}", len(t or "")) for i, (t, x) in enumerate(zip(texts, langs))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = language.Model(language.learn(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    kept = [r for r in rows if not model.predict(r[1])[2]]
    cleaned = brute_lines([r[1] for r in kept])
    kept = [(r[0], t, r[3]) for r, t in zip(kept, cleaned) if t == r[1] or WORD.search(t or "")]
    sets = [shingles(t, 5) for _, t, _ in kept]
    up = roots(len(kept), [(a, b) for a in range(len(kept)) for b in range(a) if sets[a] and jaccard(sets[a], sets[b])])
    kept = [r for i, r in enumerate(kept) if up[i] == i]
    kept = [r for r in kept if not any(similar(v, WORD.findall(ascii_lower(x))) for x in items for v in windows(r[1], len(x.split())))]
    assert sorted((r.doc_id, r.size) for r in found) == sorted((i, len(WORD.findall(t or ""))) for i, t, _ in kept)
    assert {5, 6, 60, 62, 63, 64}.isdisjoint(r.doc_id for r in found) and len(found) > 40
    check_mix(found, {i: s for i, _, s in kept})


def test_stages_keep_the_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None
    table = docs([None, "a b"]).withColumn("_c", F.lit(1))
    assert language.stage(table).columns == table.columns
