"""Line deduplication, near-deduplication and decontamination against brute force."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack import storage
from lodestack.llm import decontaminate, graph, hashing, lines, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def jaccard(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(text, k):
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def edited(rng, text, rate):
    out = []
    for w in text.split(" "):
        x = rng.random()
        out += [] if x < rate / 2 else [w, f"n{rng.randrange(10**6)}"] if x < rate else [w]
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(rng.randrange(5, 120)) for _ in range(30)]
    family = [edited(rng, base[0] + " " + base[1], rate) for rate in (0.02, 0.05, 0.1, 0.15) for _ in range(15)]
    chain = [base[2]]
    for _ in range(8):
        chain.append(edited(rng, chain[-1], 0.06))
    odd = [None, "", "  \n\t", "one", "one", "ONE", "a b", "A\tb", "É é", "x " * 3000, "x " * 2999]
    return base + family + chain + odd + [base[3]] * 5


def test_groups_are_those_of_brute_force(docs, corpus):
    for k in (2, 5):
        sets = [shingles(t, k) for t in corpus]
        n = len(corpus)
        expected = roots(n, [(a, b) for a in range(n) for b in range(a) if sets[a] and jaccard(sets[a], sets[b])])
        found = {r.doc_id: r for r in neardup.op5(docs(corpus), k).collect()}
        assert [found[i].component_id for i in range(n)] == expected
        assert [found[i].n_shingles for i in range(n)] == [len(s) for s in sets]
        assert [found[i].kept for i in range(n)] == [i == e for i, e in enumerate(expected)]


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(4)
    both = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for share in (0.5, 0.8):
        cut = int(1000 * (1 - share) / 2)
        a, b = both[: 1000 - cut], both[cut:]
        got = neardup.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert abs((got[0] == got[1]).mean() - (1000 - 2 * cut) / 1000) < 0.1
    small = neardup.sketch(np.array([5, 6, 5], np.uint64), np.array([0, 2, 2, 3]))
    assert (small[0] < 2**64 - 1).all() and (small[1] == 2**64 - 1).all() and (small[2] < 2**64 - 1).all()


def test_word_hashes_are_those_of_words():
    texts = ["Ab  c\n", None, "", "ab c", "\x0bé ab", "a" * 5000]
    data, at = hashing.texts(pa.array(texts))
    found, to = hashing.word_hashes(data, at)
    words = [WORD.findall(ascii_lower(t or "")) for t in texts]
    assert np.diff(to).tolist() == [len(w) for w in words]
    known = {}
    for w, h in zip([w for ws in words for w in ws], found):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \nAé") for _ in range(rng.randrange(60))) for _ in range(50)] + ["x" * 300, "", None, "y" * 100 + " " + "z" * 90]
    data, at = hashing.texts(pa.array(texts))
    whole = hashing.word_hashes(data, at)
    for piece in (1, 2, 7, 50):
        monkeypatch.setattr(hashing, "PIECE", piece)
        for a, b in zip(whole, hashing.word_hashes(data, at)):
            assert a.tolist() == b.tolist()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(999, i) for i in range(400, 420)]
    up = roots(1000, edges)
    found = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: up[x] for x in touched if up[x] != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_a_dense_family(spark):
    """All members share one bucket: links between members that aren't linked to the hub are found too."""
    rng = random.Random(8)
    sets = []
    for rate in (0.05, 0.1, 0.2, 0.3) * 20:
        s = {t for t in range(60) if rng.random() > rate / 2} | {rng.randrange(10**6, 10**7) for _ in range(int(30 * rate))}
        sets += [s, (s - {min(s)}) | {77}]
    n = len(sets)
    expected = roots(n, [(a, b) for a in range(n) for b in range(a) if jaccard(sets[a], sets[b])])
    members = spark.createDataFrame([(1, i, n) for i in range(n)], "key long, id long, k long")
    items = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, items array<long>")
    before = set(os.listdir(storage.scratch_dir(spark)))
    found = {r.id: r.root for r in graph.link(members, items, 80).collect()}
    assert [found.get(i, i) for i in range(n)] == expected
    assert len(set(expected)) > 2
    assert len(set(os.listdir(storage.scratch_dir(spark))) - before) == 1, "only the result is left of the tables in between"


def test_differences_of_sets_with_repeated_tokens(spark):
    """The set sizes are those of distinct tokens, and no token is taken for the other side's."""
    rng = random.Random(29)
    some = [[rng.randrange(12) for _ in range(rng.randrange(0, 20))] for _ in range(40)]
    sets = spark.createDataFrame(list(enumerate(some)), "id long, items array<long>")
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(40) if a != b], "h long, id long")
    found = graph._differences(pairs, sets, 80, lambda c: c).collect()
    assert len(found) == 40 * 39
    for r in found:
        a, b = set(some[r.h]), set(some[r.id])
        assert (r.nh, r.n, sorted(r["diff"])) == (len(a), len(b), sorted([*(b - a), *(~x for x in a - b)]))
        assert r.linked == (100 * len(a & b) >= 80 * len(a | b))


@pytest.mark.parametrize("k", [300, 1200])
def test_clusters_in_one_bucket(spark, k, monkeypatch):
    """Two clusters around centres of 60 % similarity: pairs that are compared at the end grow no faster than members."""
    rng = random.Random(k)
    centre = set(range(400))
    other = set(range(100, 500))
    sets = [c - {rng.choice(sorted(c))} | {rng.randrange(10**6, 10**8)} for c in (centre, other) for _ in range(k)]
    members = spark.createDataFrame([(1, i, 2 * k) for i in range(2 * k)], "key long, id long, k long")
    items = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, items array<long>")
    compared, verify = [], graph.verify

    def counted(pairs, *more):
        compared.append(pairs.count())
        return verify(pairs, *more)

    monkeypatch.setattr(graph, "verify", counted)
    found = {r.id: r.root for r in graph.link(members, items, 80).collect()}
    up = [found.get(i, i) for i in range(2 * k)]
    assert len(set(up[:k])) == len(set(up[k:])) == 1 and up[0] != up[k]
    assert sum(compared) <= 4 * graph.PIVOTS * k


def rare_rows(monkeypatch):
    """The rows and the tokens that ``graph._rare`` is given from now on."""
    given, rare = [], graph._rare

    def counted(at):
        given.append(tuple(at.agg(F.count("*"), F.sum("d")).first()))
        return rare(at)

    monkeypatch.setattr(graph, "_rare", counted)
    return given


def test_members_of_several_groups_are_settled_once(spark, monkeypatch):
    """Members 0 to 98 share a bucket with the hub 99, and another without it; 99 has the larger group."""
    rng = random.Random(5)
    sets = [{t for t in range(60) if rng.random() > 0.12} | {rng.randrange(10**6, 10**7) for _ in range(rng.randrange(8))} for _ in range(100)]
    sets += [{rng.randrange(10**7, 10**8) for _ in range(30)} for _ in range(100)]
    expected = roots(100, [(a, b) for a in range(100) for b in range(a) if jaccard(sets[a], sets[b])])
    rows = [(1, i, 100) for i in range(100)] + [(2, i, 99) for i in range(99)] + [(3, i, 101) for i in range(99, 200)]
    items = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, items array<long>")
    given = rare_rows(monkeypatch)
    found = {r.id: r.root for r in graph.link(spark.createDataFrame(rows, "key long, id long, k long"), items, 80).collect()}
    assert [found.get(i, i) for i in range(100)] == expected and len(set(expected)) > 5
    assert not any(i in found for i in range(100, 200))
    assert len(given) == 1 and given[0][0] <= 200


def test_differences_from_what_most_members_have(spark, monkeypatch):
    """A hub unlike all others: what it alone has or lacks is no part of their differences; those near the centre share no token."""
    rng = random.Random(6)
    sets = [set(range(100)) - {rng.randrange(100)} | {rng.randrange(10**6, 10**8) for _ in range(rng.choice((1, 2, 30)))} for _ in range(149)]
    sets.append(set(range(50, 100)) | set(range(200, 250)))
    expected = roots(150, [(a, b) for a in range(150) for b in range(a) if jaccard(sets[a], sets[b])])
    rows = [(1, i, 150) for i in range(150)] + [(2, i, 2) for i in (148, 149)]
    items = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, items array<long>")
    monkeypatch.setattr(graph, "ROUNDS", 0)
    given = rare_rows(monkeypatch)
    found = {r.id: r.root for r in graph.link(spark.createDataFrame(rows, "key long, id long, k long"), items, 80).collect()}
    assert [found.get(i, i) for i in range(150)] == expected and len(set(expected)) > 5
    assert sum(d for _, d in given) <= 149 * 35


def test_pipeline_stage_keeps_one_of_each(spark, docs):
    text = " ".join(f"w{i}" for i in range(50))
    table = docs([text, text + " more", "other words entirely here now", None, "", text])
    twice = table.unionByName(table.where("doc_id in (0, 2)"))
    kept = neardup.stage(twice)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    assert neardup.stage(table.limit(0)).count() == 0 and neardup.op5(table.limit(0)).count() == 0


def test_null_ids(spark):
    rows = [(None, "a b c"), (7, "a b c"), (None, "only here"), (None, "only here")]
    found = neardup.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [(-1, -1, True), (-1, -1, True), (-1, 7, False), (7, 7, True)]


def line_set(line):
    octets = line.strip(" \t\r\x0b\x0c").lower().encode()
    return {octets[i : i + lines.SHINGLE] for i in range(max(1, len(octets) - lines.SHINGLE + 1))} if octets else set()


def brute_lines(texts):
    where = [(d, i, line_set(x)) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if line_set(x)]
    up = roots(len(where), [(a, b) for a in range(len(where)) for b in range(a) if jaccard(where[a][2], where[b][2])])
    gone = {where[k][:2] for k, r in enumerate(up) if r != k}
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) if t else t for d, t in enumerate(texts)]


def test_lines_are_those_of_brute_force(docs, corpus):
    rng = random.Random(6)
    some = [t for t in corpus if t]
    texts = ["\n".join(rng.choice(some) for _ in range(rng.randrange(1, 6))) for _ in range(25)] + [None, "", "\n \n", "HOT line\nhot line \n\n hot line", "é" * 40, "Hot Line"]
    found = {r.doc_id: r for r in lines.op2(docs(texts).select("doc_id", "text")).collect()}
    assert [found[i].text for i in range(len(texts))] == brute_lines(texts)
    assert found[25].kept and found[26].kept and found[27].kept and not found[30].kept


def test_lines_stage(spark, docs):
    table = docs(["a first line of words\nshared line in all texts", "shared line in all texts", None, ""])
    out = {r.doc_id: r.text for r in lines.stage(table.unionByName(table)).distinct().collect()}
    assert out == {0: "a first line of words\nshared line in all texts", 2: None, 3: ""}
    assert lines.stage(table).columns == table.columns
    assert lines.stage(table.limit(0)).count() == 0


def test_lines_that_differ_late_in_long_words_stay(docs):
    rng = random.Random(12)
    urls = [f"https://www.{rng.choice('abcdefgh') * 3}{i}.org/page/{rng.randrange(10**9)}" for i in range(30)]
    chinese = ["\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u4e00\u8d77\u53bb" + "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(25)) for _ in range(20)]
    near = [urls[0] + "x", urls[1], chinese[0] + "\u5427", chinese[1][:-1], "See https://example.org/a", "See https://example.com/zzz", "a/" * 40, "a/" * 41]
    some = urls + chinese + near
    sets = [line_set(x) for x in some]
    up = roots(len(some), [(a, b) for a in range(len(some)) for b in range(a) if jaccard(sets[a], sets[b])])
    found = {r.doc_id: r for r in lines.op2(docs(some).select("doc_id", "text")).collect()}
    assert [found[i].kept for i in range(len(some))] == [r == i for i, r in enumerate(up)]
    assert 50 <= sum(r == i for i, r in enumerate(up)) < len(some)


@pytest.mark.parametrize("common", [4, 8, 40, 160, 700])
def test_lines_with_four_of_five_shingles_meet(docs, common):
    """Recall at a similarity of 0.8, the least that is linked."""
    rng = random.Random(13)
    some = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(common * 5 // 4 + lines.SHINGLE - 1)) for _ in range(400)]
    texts = some + [x[: common + lines.SHINGLE - 1] for x in some]
    found = lines.op2(docs(texts).select("doc_id", "text")).collect()
    gone = sorted(r.doc_id for r in found if not r.kept)
    assert min(gone) >= 400 and len(gone) >= 0.98 * 400


def test_lines_that_repeat_few_shingles(docs):
    """Sets are compared, whatever the lengths, also if a limit by length takes few of a line's shingles."""
    rng = random.Random(17)
    block = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    some = ["-" * n for n in (12, 40, 5000, 90000)]
    for n in (2, 5, 40, 150):
        b = block(n)
        some += [(b * k)[:-1] for k in (30, 33, 200, 900)]
    some += [block(5000), "x" * 11, block(9)]
    sets = [line_set(x) for x in some]
    up = roots(len(some), [(a, b) for a in range(len(some)) for b in range(a) if jaccard(sets[a], sets[b])])
    found = {r.doc_id: r for r in lines.op2(docs(some).select("doc_id", "text")).collect()}
    assert [found[i].kept for i in range(len(some))] == [r == i for i, r in enumerate(up)]


def test_a_shingle_touches_the_smallest_hash_of_its_bin_only(docs):
    """The other bins' buffers are left alone: a filter of each aggregate, not a condition that writes them all."""
    table = lines._lines(docs(["one line of text\nanother line of it"])).select(F.col("_ls_th").alias("text"), "line")
    plan = lines._coordinates(table, lines._limit)._jdf.queryExecution().toString()
    plan = plan[plan.index("Physical Plan") :]
    assert all(re.search(rf"partial_min\(h#\d+L\) FILTER \(WHERE \(bin#\d+ = {j}\)\)", plan) for j in range(lines.BINS))


def test_lines_of_a_table_with_clashing_columns(spark, docs):
    table = docs(["one shared line of text", "one shared line of text\nanother line here"])
    for name in ("gone", "line", "line_no", "i1", "c", "first", "root", "h", "more"):
        table = table.withColumn(name, F.lit("own"))
    out = {r.doc_id: r for r in lines.stage(table).collect()}
    assert out[1].text == "another line here" and out[1].gone == "own" and 0 in out


def windows(text, n):
    w = WORD.findall(ascii_lower(text or ""))
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def weighted(words):
    k = min(5, len(words))
    out = {}
    for i in range(len(words) - k + 1):
        s = " ".join(words[i : i + k])
        out[s] = out.get(s, 0) + len(s)
    return out


def similar(a, b):
    a, b = weighted(a), weighted(b)
    both = sum(min(a[s], b[s]) for s in a if s in b)
    return 100 * both >= 80 * (sum(a.values()) + sum(b.values()) - both)


def test_decontamination_against_all_windows(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(150)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(n) for n in (3, 8, 20, 20, 45, 60)] + [None, "", "Solo"]
    items.append(items[2])
    texts = [text(rng.randrange(1, 150)) for _ in range(15)]
    for item in items[1:6]:
        w = item.split()
        texts.append(text(20) + " " + item.upper() + "\n" + text(10))
        texts.append(text(9) + " " + " ".join(w[:-1] + ["changed"]) + " " + text(9))
        texts.append(" ".join(w[: len(w) // 2]) + " " + text(30))
        texts.append(" ".join(w[: len(w) // 2] + ["in"] + w[len(w) // 2 :]))
    texts += [None, "", "solo", "not SOLO here", items[0]]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.op6(docs(texts), benchmark).collect()}
    for d, t in enumerate(texts):
        expected = [i for i, x in enumerate(items) if x and any(similar(v, WORD.findall(ascii_lower(x))) for v in windows(t, len(x.split())))]
        assert found[d].items == ",".join(map(str, expected)), (d, t)
        assert found[d].kept == (not expected) and found[d].n_items == len(expected)
    clean = decontaminate.stage(docs(texts), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == [d for d in found if found[d].kept] and clean.columns == docs(texts).columns


def test_decontamination_finds_other_orders_and_short_texts(spark, docs):
    rng = random.Random(14)
    text = lambda n: " ".join(f"word{rng.randrange(10**5)}" for _ in range(n))
    item, four = text(60).split(), text(4)
    swapped = " ".join(item[30:] + item[:30])
    texts = [text(40) + " " + swapped + " " + text(40), swapped, " ".join(item[:-1]), " ".join(item[:40]), text(9) + " " + " ".join(item[:-1]), four, text(200)]
    moved = " ".join(item[3:] + item[:3])
    edge = " ".join(item[:-1] + ["http://" + "x" * 60])
    texts += [text(7) + " " + moved + " " + text(80), text(30) + " " + edge, " ".join([swapped] * 3)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, four), (3, text(30))], "item_id long, text string")
    table = docs(texts).unionByName(docs(texts)).withColumns({c: F.lit("own") for c in ("wid", "w", "n", "k", "h", "item_id", "print", "items")})
    found = decontaminate.op6(table, benchmark).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        expected = [i for i, x in ((1, " ".join(item)), (2, four)) if any(similar(v, x.split()) for v in windows(texts[r.doc_id], len(x.split())) or [texts[r.doc_id].split()])]
        assert r.items == ",".join(map(str, expected))
    assert [next(r.items for r in found if r.doc_id == i) for i in range(7)] == ["1", "1", "1", "", "1", "2", ""]
    assert decontaminate.stage(table, benchmark).columns == table.columns


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.kept for r in decontaminate.op6(docs(["a b", None]), none).collect()] == [True, True]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.op6(docs(["x"]).limit(0), some).count() == 0


def distances(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, shingles array<string>")
    p = [r.print for r in sorted(decontaminate.prints(rows, "key").collect(), key=lambda r: r.key)]
    return [sum(bin((i ^ j) & (2**64 - 1)).count("1") for i, j in zip(p[0], x)) for x in p]


def test_simhash_is_near_for_similar_texts(spark):
    a = [f"shingle number {i}" for i in range(60)]
    same, near, far = distances(spark, a, a[3:] + ["x", "y", "z"], [f"other {i}" for i in range(60)])
    assert same == 0 and near <= decontaminate.RADIUS < far


def test_simhash_of_a_heavy_shingle_and_of_repetitions(spark):
    """Similarity 0.8 keeps within the radius if the weight that differs is one shingle's, or that of repetitions."""
    a = [f"shingle number {i}" for i in range(60)]
    weight = sum(map(len, a))
    same, heavy, often = distances(spark, a, a + ["h" * (weight // 4)], a + [a[0]] * 15)
    assert same == 0 and heavy <= decontaminate.RADIUS and often <= decontaminate.RADIUS


def test_near_values_meet_within_the_radius(spark):
    rng = random.Random(21)
    a = [rng.getrandbits(128) for _ in range(200)]
    b = [x ^ sum(1 << i for i in rng.sample(range(128), decontaminate.RADIUS)) for x in a]
    c = [rng.getrandbits(128) for _ in range(200)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = spark.createDataFrame([[[signed(v % 2**64), signed(v >> 64)] for v in vs] for vs in zip(a, b, c)], "a array<long>, b array<long>, c array<long>")
    meet = lambda x, y: F.size(F.array_intersect(decontaminate._near(F.col(x), 2), decontaminate._near(F.col(y), 1))) > 0
    found = rows.select(meet("a", "b").alias("near"), meet("a", "c").alias("far")).collect()
    assert all(r.near for r in found) and sum(r.far for r in found) <= 40
