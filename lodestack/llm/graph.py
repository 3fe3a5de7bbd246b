"""Linking near-duplicates: exact verification of banding candidates and distributed connected components.

Everything here is DataFrame code. Buckets are never expanded into all their pairs: a bucket's members are compared
with its hub, then those left apart with a few pivots, and only members of different components that exact bounds do
not keep apart with one another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, same_table, save, scope, small


#: Rows of single longs (band keys with company) up to which they are broadcast: 16 MB.
KEY_ROWS = 2_000_000

#: Members of a hub's group up to which they are compared with one another.
FEW = 64

#: Members of a large group whose differences say what most of its members have, and such groups up to which that is broadcast.
DRAWN, COMMON_ROWS = 64, 10_000

#: A token is frequent if more members of a group have it than ``OFTEN`` and than one in ``SHARE`` of them, so a group has
#: no more such tokens than ``SHARE`` members have differences.
OFTEN, SHARE = 64, 32

#: Members apart from their hub from which on a group gets pivots, how many in a round, and rounds. Another round comes
#: only if the last one linked one in ``WORTH`` of those members.
APART, PIVOTS, ROUNDS, WORTH = 128, 2, 32, 8


def buckets(keys: DataFrame) -> DataFrame:
    """Members ``(key, id, k)`` of all buckets with two or more different ids; ``k``: the bucket's members.

    ``keys(id, keys array<long>)`` has a row for each item and no key twice in a row.
    """
    rows = keys.select("id", F.explode("keys").alias("key"))
    shared = save(rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    return rows.join(small(shared, KEY_ROWS), "key")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, items: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The linked ones of ``pairs(a, b)``: 100 * intersection >= percent * union, on the full sets ``items(sets.items)``."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("ra"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("rb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", items(F.col("ra")).alias("sa"), items(F.col("rb")).alias("sb"))
    return both.where(100 * F.size(F.array_intersect("sa", "sb")) >= percent * F.size(F.array_union("sa", "sb"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every id in ``edges(a, b)`` but the roots themselves; the root is the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014) on the edge list; every step is two aggregates
    and two joins on ids, and the state of each round is written to shared storage.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = save(e, "edges")
    # done when all components are stars around their smallest id: no end of an edge is the start of another, and no
    # node has two edges up
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        last, e = e, save(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct(), "edges")
        discard(last)
    return same_table(e.select(F.col("u").alias("id"), F.col("v").alias("root")), e)


def _stars(e: DataFrame) -> bool:
    ends = e.select("u").unionByName(e.select(F.col("v").alias("u")).distinct())
    return ends.groupBy("u").agg(F.count("*").alias("k")).where("k > 1").isEmpty()


def _differences(pairs: DataFrame, sets: DataFrame, percent: int, items: Callable[[Column], Column]) -> DataFrame:
    """``pairs(h, id)`` compared exactly: ``linked``, set sizes ``nh`` and ``n``, and ``diff``, the tokens in one only.

    Tokens that the hub alone has are told from the others by their complement. ``items`` may repeat tokens.
    """
    left = sets.select(F.col("id").alias("h"), F.col("items").alias("rh"))
    right = sets.select("id", F.col("items").alias("r"))
    both = pairs.join(left, "h").join(right, "id").select("h", "id", items(F.col("rh")).alias("sh"), items(F.col("r")).alias("s"))
    # the hub's distinct tokens are cheaper to count than those of the intersection, which is what is left of them
    both = both.select("h", "id", F.array_except("s", "sh").alias("more"), F.array_except("sh", "s").alias("less"), F.size(F.array_distinct("sh")).alias("nh"))
    diff = F.concat("more", F.transform("less", lambda x: F.bitwise_not(x)))
    both = both.select("h", "id", "nh", (F.col("nh") - F.size("less") + F.size("more")).alias("n"), diff.alias("diff"))
    return both.withColumn("linked", F.size("diff") * (100 + percent) <= (F.col("n") + F.col("nh")) * (100 - percent))


def _placed(tested: DataFrame, roots: DataFrame) -> DataFrame:
    """``tested`` with each member's component ``c``."""
    return tested.join(small(roots, KEY_ROWS), "id", "left").withColumn("c", F.coalesce("root", "id")).drop("root")


def _open(tested: DataFrame, roots: DataFrame) -> DataFrame:
    """``(h, k)`` of the hubs' groups that lie in two components or more, and the number of their members."""
    at = _placed(tested.select("h", "id"), roots)
    found = at.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("h", "k")
    return save(found, "open")


def _pivoted(tested: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, items: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """``roots`` after rounds of pivots, so that large clusters apart from their hub become one component; and the open groups.

    In each round, if more than ``APART`` of a group's members are outside its hub's component, they are compared with
    ``PIVOTS`` of them, drawn at random: so many comparisons a member, whatever the group's size.
    """
    open_ = _open(tested, roots)
    for turn in range(ROUNDS):
        large = open_.where(F.col("k") > APART).select("h")
        if large.isEmpty():
            break
        rest = _placed(tested.select("h", "id"), roots).join(small(large, KEY_ROWS), "h")
        hub = roots.select(F.col("id").alias("h"), F.col("root").alias("hr"))
        rest = rest.join(small(hub, KEY_ROWS), "h", "left").where(F.col("c") != F.coalesce("hr", "h")).select("h", "id", "c")
        rest = save(rest, "rest")
        drawn = [F.min_by("id", F.xxhash64("id", F.lit(turn), F.lit(p))).alias(f"p{p}") for p in range(PIVOTS)]
        pivots = rest.groupBy("h").agg(F.count("*").alias("k"), *drawn).where(F.col("k") > APART)
        pivots = pivots.select("h", F.explode(F.array_distinct(F.array(*[f"p{p}" for p in range(PIVOTS)]))).alias("a"))
        own = rest.select("h", F.col("id").alias("a"), F.col("c").alias("ca"))
        pivots = save(pivots.join(own, ["h", "a"]), "pivots")
        if pivots.isEmpty():
            break
        pairs = rest.join(small(pivots), "h").where((F.col("a") != F.col("id")) & (F.col("c") != F.col("ca")))
        links = save(verify(pairs.select("a", F.col("id").alias("b")).distinct(), sets, percent, items), "links")
        n = links.count()
        if n:
            roots = _joined(roots, links)
            open_ = _open(tested, roots)
        if n * WORTH < rest.count():
            break
    return roots, open_


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    return components(links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))


def _unsettled(tested: DataFrame, roots: DataFrame, open_: DataFrame, sets: DataFrame, percent: int, items: Callable[[Column], Column]) -> DataFrame:
    """Links ``(a, b)`` between members of a hub's group that are in different components; ``tested`` is deleted.

    Let D be a member's difference from the hub, n its size, c = (100 - percent) / (100 + percent) and q = |D| - c n. Two
    members are linked just if |Da ^ Db| <= c (na + nb), that is if |Da & Db| >= (qa + qb) / 2. Of two members in different
    components one at least is not linked to the hub.

    Members of the same groups often have many of these in common. The home of a member is the largest of its groups, and
    two members with the same home are settled there only; two others in each group that has both.

    In groups of up to ``FEW`` members that is computed for each pair, in larger ones as ``_rare`` says. If a larger group
    has no more pairs of different homes than ``FEW`` members have pairs, these are computed too, and only the members
    that are at home are left to ``_rare``.
    """
    c = (100 - percent) / (100 + percent)
    at = _placed(tested, roots)
    at = at.join(small(open_, KEY_ROWS), "h").withColumn("d", F.size("diff")).withColumn("q", F.col("d") - c * F.col("n"))
    homes = tested.select("h", "id").join(small(open_, KEY_ROWS), "h").groupBy("id").agg(F.max(F.struct("k", "h")).alias("o"))
    homes = save(homes.select("id", F.col("o.h").alias("home")), "homes")
    at = at.join(small(homes, KEY_ROWS), "id")
    at = save(at.select("h", "k", "id", "c", "linked", "d", "q", "home", "diff"), "diffs", hashes=True)
    discard(tested)
    parts = at.groupBy("h", "home").agg(F.count("*").alias("n"))
    size, alike = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    own = F.sum(F.when(F.col("home") == F.col("h"), F.col("n")).otherwise(0)).alias("own")
    shape = parts.groupBy("h").agg(((size * size - alike) / 2).alias("cross"), F.max_by("home", "n").alias("major"), own)
    at = at.join(small(save(shape, "shape"), KEY_ROWS // 4), "h")

    little, mixed = F.col("k") <= FEW, F.col("cross") <= FEW * (FEW - 1) // 2
    minor = (F.col("home") != F.col("major")) | ((F.col("home") == F.col("h")) & (F.col("own") <= FEW))
    near = at.where(little | mixed).withColumn("first", little | minor)
    x, y = (near.select("h", *[F.col(v).alias(v + s) for v in ("id", "c", "linked", "d", "q", "home", "first", "diff")]) for s in "ab")
    need = (F.col("qa") + F.col("qb")) / 2 - 1e-9
    apart = (F.col("ca") != F.col("cb")) & ~(F.col("linkeda") & F.col("linkedb"))
    here = (F.col("homea") != F.col("homeb")) | (F.col("homea") == F.col("h"))
    pairs = x.where("firsta").join(y, "h").where((~F.col("firstb") | (F.col("ida") < F.col("idb"))) & here & apart & (need <= F.least("da", "db")))
    direct = pairs.where(F.size(F.array_intersect("diffa", "diffb")) >= need).select(F.col("ida").alias("a"), F.col("idb").alias("b"))
    rest = at.where(~little & (~mixed | ((F.col("home") == F.col("h")) & (F.col("own") > FEW))))
    rest = rest.select("h", "id", "c", "linked", "d", "q", "diff")
    if rest.isEmpty():
        return direct
    rest, links = _centred(rest)
    return direct.unionByName(links).unionByName(verify(_rare(rest), sets, percent, items))


def _centred(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``at`` with differences from what most members of a group have, instead of from the hub; and links ``(a, b)``.

    A token that most of ``DRAWN`` members have changes sides: who had it loses it, who hadn't gets it. Two members'
    differences then differ in the same tokens as before, so the test of a pair holds as it is, whichever members are drawn.

    Pairs with qa + qb <= 0 are linked even if they share no token. All members of such pairs are linked to the group's
    member of least q, so these links stand for them, and the members take its component. Other pairs share a token.
    """
    order = Window.partitionBy("h").orderBy(F.xxhash64("id"), "id")
    drawn = at.select("h", "id").withColumn("_ls_n", F.row_number().over(order)).where(F.col("_ls_n") <= DRAWN).drop("_ls_n")
    drawn = save(drawn, "drawn")
    few = save(drawn.groupBy("h").agg(F.count("*").alias("m")), "few")
    tokens = at.join(small(drawn), ["h", "id"]).select("h", F.explode("diff").alias("t")).groupBy("h", "t").agg(F.count("*").alias("f"))
    common = tokens.join(small(few), "h").where("2 * f > m").groupBy("h").agg(F.collect_list("t").alias("common"))
    at = at.join(small(save(common, "common"), COMMON_ROWS), "h", "left")
    other = F.concat(F.array_except("diff", "common"), F.array_except("common", "diff"))
    at = at.withColumn("diff", F.when(F.col("common").isNull(), F.col("diff")).otherwise(other)).drop("common")
    at = save(at.withColumn("q", F.col("q") + F.size("diff") - F.col("d")).withColumn("d", F.size("diff")), "centred", hashes=True)
    least = at.groupBy("h").agg(F.min(F.struct("q", "id", "c")).alias("p")).where("p.q <= 0")
    at = at.join(small(save(least, "least"), KEY_ROWS // 4), "h", "left").withColumn("star", F.coalesce(F.col("q") + F.col("p.q") <= 1e-9, F.lit(False)))
    links = at.where(F.col("star") & (F.col("c") != F.col("p.c"))).select(F.col("p.id").alias("a"), F.col("id").alias("b"))
    return at.withColumn("c", F.when(F.col("star"), F.col("p.c")).otherwise(F.col("c"))).drop("p", "star"), links


def _rare(at: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of members in different components that share a token and may be linked.

    The pairs of two members not linked to the hub (U) and those of one that is (L) and one that isn't are found apart,
    as their bounds differ. With s the number of a member's tokens that such a partner has, and m the least q among the
    partners, a member must have s >= tau = (q + m) / 2, and its pairs share one of its s - tau + 1 rarest such tokens.
    Members for whom no partner's 2 s - q reaches their q have no pair. These bounds are taken twice, the second time from
    members that have passed the first. Only what is left is joined by token.
    """
    far = ~F.col("linked")
    least = at.groupBy("h").agg(F.min(F.when(far, F.col("q"))).alias("mu"), F.min(F.when(~far, F.col("q"))).alias("ml"), F.count("*").alias("k"))
    least = save(least.where("mu is not null"), "least")
    # a member linked to the hub needs a partner of q <= 2 |D| - q, as they share |D| tokens at most
    held = at.join(small(least, KEY_ROWS // 4), "h").where(far | (F.col("mu") <= 2 * F.col("d") - F.col("q")))
    tokens = held.select("h", "id", "c", "linked", F.explode("diff").alias("t"))
    often = tokens.groupBy("h", "t").agg(
        F.count("*").alias("f"), F.min(F.when(far, F.col("c"))).alias("lu"), F.max(F.when(far, F.col("c"))).alias("hu"), F.count_if("linked").alias("fl"), F.min("c").alias("lo"), F.max("c").alias("hi")
    )
    often = often.where("lu is not null and lo <> hi").join(small(least.select("h", "k"), KEY_ROWS // 4), "h")
    frequent = F.col("f") > F.greatest(F.lit(OFTEN), F.col("k") / SHARE)
    often = save(often.select("h", "t", "f", (F.col("lu") != F.col("hu")).alias("uu"), (F.col("fl") > 0).alias("ul"), frequent.alias("frequent")), "often")
    entry = F.struct("f", "t")
    both = F.collect_list(F.when(F.col("uu") & far, entry)), F.collect_list(F.when(F.col("ul"), entry))
    scarce = often.where("not frequent").drop("frequent")
    shared = tokens.join(small(scarce, KEY_ROWS // 8), ["h", "t"]).groupBy("h", "id").agg(both[0].alias("uu"), both[1].alias("ul"))
    # frequent tokens come last in the order, and a group's are one row
    last = often.where("frequent").groupBy("h").agg(F.collect_list(F.when(F.col("uu"), F.col("t"))).alias("lastu"), F.collect_list(F.when(F.col("ul"), F.col("t"))).alias("lastl"))
    rows = held.join(shared, ["h", "id"], "left").join(small(save(last, "last"), COMMON_ROWS), "h", "left")
    none = F.array().cast("array<struct<f:bigint,t:bigint>>")
    end = lambda ts: F.coalesce(F.transform(F.array_intersect("diff", ts), lambda t: F.struct(F.lit(2**63 - 1).alias("f"), t.alias("t"))), none)
    lists = {"uu": F.concat(F.coalesce("uu", none), F.when(far, end("lastu")).otherwise(none)), "ul": F.concat(F.coalesce("ul", none), end("lastl"))}
    rows = rows.withColumns({k: F.array_sort(v) for k, v in lists.items()}).where("size(uu) > 0 or size(ul) > 0")
    rows = save(rows.drop("diff", "d", "k", "lastu", "lastl"), "shared")

    # the bounds once more, from members that are still in question only
    q, uu, ul = F.col("q"), F.size("uu"), F.size("ul")
    sides = {"uu": (far, uu, "mu"), "u": (far, ul, "ml"), "l": (~far, ul, "mu")}
    enough = {k: which & F.col(m).isNotNull() & (s >= F.greatest(F.lit(1.0), (q + F.col(m)) / 2 - 1e-9)) for k, (which, s, m) in sides.items()}
    bounds = [f(F.when(enough[k], x)).alias(f"{n}_{k}") for k, (_, s, _) in sides.items() for n, f, x in (("m", F.min, q), ("top", F.max, 2 * s - q))]
    rows = rows.join(small(save(rows.groupBy("h").agg(*bounds), "bounds"), KEY_ROWS // 8), "h")
    side = lambda k, other, s: _side(rows.where(enough[k]), "ul" if k != "uu" else "uu", f"m_{other}", f"top_{other}", s)
    return _met(side("uu", "uu", "a"), side("uu", "uu", "b"), True).unionByName(_met(side("u", "l", "a"), side("l", "u", "b"), False)).distinct()


def _side(rows: DataFrame, tokens: str, least: str, top: str, s: str) -> DataFrame:
    """Members that may have a partner, with each token of their prefix, rarest first, and its place in it."""
    tau = F.greatest(F.lit(1), F.ceil((F.col("q") + F.col(least)) / 2 - 1e-9)).cast("int")
    rows = rows.where(F.col(least).isNotNull() & (F.col("q") <= F.col(top) + 1e-9))
    rows = rows.select("h", "id", "c", "q", tau.alias("tau"), F.size(tokens).alias("s"), F.col(tokens).alias("ts")).where("s >= tau")
    # the optimiser may look at the prefix of rows that the condition on s leaves out
    first = F.transform(F.slice("ts", F.lit(1), F.greatest(F.lit(0), F.col("s") - F.col("tau") + 1)), lambda x: x["t"])
    rows = rows.withColumn("first", first)
    return rows.select("h", *[F.col(v).alias(v + s) for v in ("id", "c", "q", "s", "first")], F.posexplode("first").alias("at" + s, "t"))


def _met(x: DataFrame, y: DataFrame, same: bool) -> DataFrame:
    """Pairs of the two sides that share a token of their prefixes, as far as places and numbers of tokens allow it."""
    need = (F.col("qa") + F.col("qb")) / 2 - 1e-9
    # a pair counts at the first token that both prefixes have, from which on all tokens in common come
    most = F.least(F.col("sa") - F.col("ata"), F.col("sb") - F.col("atb"))
    order = F.col("ida") < F.col("idb") if same else F.col("ida") != F.col("idb")
    met = x.join(y, ["h", "t"]).where(order & (F.col("ca") != F.col("cb")) & (need <= most))
    met = met.where(F.get(F.array_intersect("firsta", "firstb"), F.lit(0)) == F.col("t"))
    return met.select(F.col("ida").alias("a"), F.col("idb").alias("b"))


def link(members: DataFrame, sets: DataFrame, percent: int, items: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``(id, root)`` of the components that verified links form; ids without a link, and roots, are left out.

    ``members(key, id, k)`` are the buckets, ``sets(id, items)`` what the full sets of all members are made of by
    ``items``. Every bucket has a hub, the member that shares most buckets with others, and each member is compared
    exactly with its hubs. Clusters that this leaves apart are gathered around pivots (``_pivoted``). Pairs of members
    that are then still in different components are compared if their differences from the hub leave it possible
    (``_unsettled``), so no candidate pair is lost, and a group around its hub costs one comparison a member.
    """
    with scope(members.sparkSession) as keep:
        return keep(_linked(members, sets, percent, items))


def _linked(members: DataFrame, sets: DataFrame, percent: int, items: Callable[[Column], Column]) -> DataFrame:
    degrees = members.groupBy("id").agg(F.sum("k").alias("degree"))
    ranked = save(members.select("key", "id").join(degrees, "id"), "ranked")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "id")).alias("hub")).select("key", F.col("hub.id").alias("h"))
    pairs = ranked.join(hubs, "key").where("id <> h").select("h", "id").distinct()
    tested = save(_differences(pairs, sets, percent, items), "tested", hashes=True)
    discard(ranked)
    links = tested.where("linked").select(F.col("h").alias("a"), F.col("id").alias("b"))
    roots, open_ = _pivoted(tested, components(links), sets, percent, items)
    more = save(_unsettled(tested, roots, open_, sets, percent, items).distinct(), "more")
    return roots if more.isEmpty() else _joined(roots, more)
