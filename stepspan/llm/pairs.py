"""Links inside the buckets of locality-sensitive hashing, without expanding a bucket into all its pairs.

First each bucket's members meet its pivot, the member that shares most with the rest (a base of many copies, if there is
one). The members that met a pivot p are p's family. Members of a family that are of one component need no further
comparison. For the others:

Small families (SMALL members at most) are compared in pairs. Large ones take their most central member as a new pivot and
meet it. What is still of several components is compared through what sets the members apart from the pivot. With d(x) = x minus p and p minus x, the difference of x and y is that of d(x) and d(y). If x and y are
linked it is at most (|x| + |y|) r with r = (1 - t) / (1 + t), so with s(x) = |d(x)| - |x| r the sets d(x) and d(y) share
o = (s(x) + s(y)) / 2 elements or more, and by the prefix principle the first |d(x)| - o + 1 of d(x) and |d(y)| - o + 1 of
d(y), rarest in the family first, share one. A probe, a member outside the pivot's component, is no link of the pivot, so
|d(x)| > (|x| + |p|) r, and o is 1 or more for each partner. Elements of only one member match nobody: they fill the front
of a prefix but are not given out; with a central pivot these are most of it. Elements that the very same members have are
one group and are given out together. A member gives out its prefix once, for the least o that it has with any probe of the
family; the join then applies the bounds of each very pair. Before it, the members that share an element in a large group meet
the one of them that differs least from the pivot, so that a second crowd of near copies in a family becomes one component by as
many comparisons as it has members; two probes are joined one way round only. Every pair that a bucket holds is thus compared,
or shown not to be a link, or already of one component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, staged, unstage
from .components import connected_components

#: Members of a family that are compared in pairs; the most rows of a broadcast (24 bytes each).
SMALL, BROADCAST_ROWS = 16, 500_000


def shared_buckets(bands: DataFrame) -> DataFrame:
    """(key, c, ...) -> the rows of keys with two different c, with the bucket's size as `mates`, staged."""
    keys = staged(bands.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("mates")).filter("lo <> hi").select("key", "mates"), "buckets")
    return staged(bands.join(maybe_broadcast(keys, keys.count(), BROADCAST_ROWS), "key"), "members")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (c, shingles) have a Jaccard similarity of percent or more. Sets that no pair names
    are left out before they are dealt out; those of the ends are sent along only as far as they are needed."""
    sets = _named(sets, pairs, "a", "b")
    a, b = (sets.select(F.col("c").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))  # named once: a filter works out each mention anew
    return pairs.join(a, "a").join(b, "b").filter(common * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent).select("a", "b").distinct()


def _named(sets: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The sets of the c's in these columns of rows."""
    names = staged(rows.select(F.explode(F.array(*columns)).alias("c")).distinct(), "names")
    return sets.join(maybe_broadcast(names, names.count(), BROADCAST_ROWS), "c", "left_semi")


def _pairs(left: DataFrame, right: DataFrame, on: list[str], percent: int) -> DataFrame:
    """(a, b) of different components that meet on `on`, alike enough in size; distinct."""
    x = left.select(*on, F.col("c").alias("x"), F.col("n").alias("nx"), F.col("component").alias("gx")).join(right.select(*on, F.col("c").alias("y"), F.col("n").alias("ny"), F.col("component").alias("gy")), on)
    x = x.filter("gx <> gy").filter(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
    return x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _through_pivot(family: DataFrame, sets: DataFrame, percent: int, verify: Callable[[DataFrame], DataFrame], links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """family: (p, c, n, component, own: p's component). Candidate pairs (a, b) by prefixes of differences, and the links and
    labels, to which those of large groups with their least member are added."""
    share = (100 - percent) / (100 + percent)
    sets = _named(sets, family, "p", "c")
    a, b = sets.select("c", F.col("shingles").alias("s")), sets.select(F.col("c").alias("p"), F.col("shingles").alias("sp"))
    d = F.concat(F.array_except("s", "sp"), F.array_except("sp", "s"))
    live = staged(family.join(a, "c").join(b, "p").select("p", "c", "n", "component", "own", d.alias("d")), "differences")
    x = live.select("p", "c", F.explode("d").alias("e"))
    # elements that the very same members have (those of one edit) are one group: df members, known by the sum of their hashes
    often = x.groupBy("p", "e").agg(F.count("*").alias("df"), F.sum(F.xxhash64("c").bitwiseAND((1 << 40) - 1)).alias("g")).filter("df > 1")
    groups = x.join(often, ["p", "e"]).groupBy("p", "c", "df", "g").agg(F.count("*").alias("w"))
    shared = groups.groupBy("p", "c").agg(F.array_sort(F.collect_list(F.struct("df", "g", "w"))).alias("es"), F.sum("w").alias("shared"))
    size = F.size("d")
    ordered = live.join(shared, ["p", "c"]).select("p", "c", "n", "component", "own", size.alias("size"), (size - F.col("shared")).alias("alone"), (size - F.col("n") * share).alias("s"), "es")
    ordered = staged(ordered, "ordered")
    sides = ordered.groupBy("p").agg(F.min("s").alias("least"), F.min(F.when(F.col("component") != F.col("own"), F.col("s"))).alias("least_probe"))
    sides = staged(sides.filter("least_probe IS NOT NULL"), "sides")

    def emitted(rows: DataFrame, least: str, end: str) -> DataFrame:
        """The groups that begin in a prefix, with the shared elements before them."""
        o = F.greatest(F.ceil((F.col("s") + F.col(least)) / 2 - 1e-6), F.lit(1))
        rows = rows.join(sides, "p").withColumn("room", F.col("size") - o - F.col("alone")).filter("room >= 0")
        before = F.aggregate(F.slice("es", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda acc, e: acc + e["w"])
        inside = F.filter(F.transform(F.sequence(F.lit(0), F.size("es") - 1), lambda k: F.struct(k.alias("k"), F.get("es", k).alias("e"))), lambda x: x["k"] <= F.col("room"))
        rows = rows.select("p", "c", "n", "component", "size", "alone", "s", "room", "es", (F.col("component") != F.col("own")).alias("probe"), F.explode(inside).alias("x"))
        rows = rows.select("*", F.col("x.k").alias("k"), F.col("x.e.df").alias("df"), F.col("x.e.g").alias("g")).withColumn("i", before).filter("i <= room")
        return rows.select("p", "df", "g", *[F.col(k).alias(f"{k}_{end}") for k in ("c", "n", "component", "size", "alone", "s", "i", "probe")])

    probes = staged(emitted(ordered.filter("component <> own"), "least", "x"), "probes")
    index = staged(emitted(ordered, "least_probe", "y"), "index")
    crowds = index.groupBy("p", "df", "g").agg(F.count("*").alias("k"), F.min("component_y").alias("lo"), F.max("component_y").alias("hi"), F.min(F.struct("size_y", "c_y", "n_y", "component_y")).alias("hub"))
    crowds = staged(crowds.filter(F.col("k") > SMALL).filter("lo <> hi").select("p", "df", "g", "hub"), "crowds")
    star = index.join(crowds, ["p", "df", "g"]).filter("component_y <> hub.component_y").filter(F.least("n_y", "hub.n_y") * 100 >= F.greatest("n_y", "hub.n_y") * percent)
    star = staged(star.select(F.least("c_y", "hub.c_y").alias("a"), F.greatest("c_y", "hub.c_y").alias("b")).distinct(), "pairs")
    if not star.isEmpty():
        links, labels = _joined(verify, star, links, labels)
        probes, index = staged(_labelled(probes, labels, component_x="c_x"), "probes"), staged(_labelled(index, labels, component_y="c_y"), "index")
    # the bounds of this very pair: both places lie in its prefixes, and enough may still follow
    o = F.ceil((F.col("s_x") + F.col("s_y")) / 2 - 1e-6)
    after = [F.col(f"size_{k}") - F.col(f"alone_{k}") - F.col(f"i_{k}") for k in "xy"]
    fits = (F.col("alone_x") + F.col("i_x") <= F.col("size_x") - o) & (F.col("alone_y") + F.col("i_y") <= F.col("size_y") - o) & (F.least(*after) + F.least("i_x", "i_y") >= o)
    alike = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    once = ~F.col("probe_y") | (F.col("c_x") < F.col("c_y"))
    met = probes.join(index, ["p", "df", "g"]).filter((F.col("component_x") != F.col("component_y")) & once & alike & fits)
    return met.select(F.least("c_x", "c_y").alias("a"), F.greatest("c_x", "c_y").alias("b")).distinct(), links, labels


def _centres(family: DataFrame, sets: DataFrame) -> DataFrame:
    """family: (p, c, ...) -> (p, q): of each family the member nearest to what most members have, if that is not p.
    An element of d is had by most if most members differ from p in it; so far does a member lie from the majority."""
    sets = _named(sets, family, "p", "c")
    a, b = sets.select("c", F.col("shingles").alias("s")), sets.select(F.col("c").alias("p"), F.col("shingles").alias("sp"))
    x = family.select("p", "c", "members").join(a, "c").join(b, "p")
    d = F.filter(F.concat(F.array_except("s", "sp"), F.array_except("sp", "s")), lambda e: F.pmod(e, F.lit(8)) == 0)  # an estimate will do to choose
    # explode_outer: of the inner form Spark derives filters, which would work out d again
    x = staged(x.select("p", "c", "members", F.explode_outer(d).alias("e")).filter("e IS NOT NULL"), "votes")
    most = x.groupBy("p", "e").agg((2 * F.count("*") > F.max("members")).alias("most"))
    far = x.join(most, ["p", "e"]).groupBy("p", "c").agg(F.sum(F.when(F.col("most"), -1).otherwise(1)).alias("far"))
    best = far.groupBy("p").agg(F.min(F.struct("far", "c")).alias("x")).filter("x.far < 0").select("p", F.col("x.c").alias("q"))
    best = staged(best, "centres")
    unstage(x)
    return best


def _labelled(df: DataFrame, labels: DataFrame, **out: str) -> DataFrame:
    """df with the components of the nodes in columns out (name = column); a node without links is its own."""
    for name, c in out.items():
        df = df.join(labels.select(F.col("node").alias(c), F.col("component").alias("__l")), c, "left").withColumn(name, F.coalesce("__l", c)).drop("__l")
    return df


def _joined(verify: Callable[[DataFrame], DataFrame], pairs: DataFrame, links: DataFrame | None, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The links so far and those of these pairs, and the components of all of them."""
    more = staged(verify(pairs), "links")
    if links is None:
        return more, staged(connected_components(more), "labels")
    if more.isEmpty():
        return links, labels
    between = _labelled(more, labels, x="a", y="b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = staged(connected_components(between), "labels")
    moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return links.unionByName(more), staged(moved.unionByName(joined.join(labels.select("node"), "node", "left_anti")), "labels")


def _open_families(family: DataFrame, labels: DataFrame) -> DataFrame:
    """family: (p, c, n) -> (p, c, n, component, own, members): the families of more than one component."""
    family = staged(_labelled(family, labels, component="c", own="p"), "family")
    kinds = family.groupBy("p").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    kinds = staged(kinds.filter("lo <> hi").select("p", "members"), "families")
    return family.join(kinds, "p")


def bucket_links(members: DataFrame, sets: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """members: (key, c, n, mates) with n the size of c's set; sets: (c, shingles); verify: pairs (a, b) -> the linked ones.
    -> (a, b): links whose components are those of all links between members of a bucket."""
    score = staged(members.groupBy("c").agg(F.sum("mates").alias("score")), "scores")
    scored = members.join(score, "c")
    pivots = staged(scored.groupBy("key").agg(F.max(F.struct("score", "c", "n")).alias("p")).select("key", F.col("p.c").alias("p"), F.col("p.n").alias("np"), F.col("p.score").alias("rank")), "pivots")
    family = staged(members.join(pivots, "key").groupBy("p", "c", "n", "np", "rank").agg(F.count("*").alias("met")), "family")
    met = family.filter("p <> c").filter(F.least("n", "np") * 100 >= F.greatest("n", "np") * percent)
    # each member meets its best pivot first, and the others only if that leaves them in different components
    best = met.groupBy("c").agg(F.max(F.struct("rank", "p")).alias("x"))
    best = staged(best.select(F.least("x.p", "c").alias("a"), F.greatest("x.p", "c").alias("b")).distinct(), "pairs")
    links, labels = _joined(verify, best, None, None)
    other = met.select("p", "c", F.least("p", "c").alias("a"), F.greatest("p", "c").alias("b")).join(best, ["a", "b"], "left_anti")
    other = staged(_labelled(other, labels, x="p", y="c").filter("x <> y").select("a", "b").distinct(), "pairs")
    links, labels = _joined(verify, other, links, labels)

    family = staged(_open_families(family.select("p", "c", "n"), labels), "live")
    small, large = family.filter(F.col("members") <= SMALL), family.filter(F.col("members") > SMALL)
    last = _pairs(small, small, ["p"], percent)
    if not large.isEmpty():
        # a pivot with edits of its own is far from many; the most central member joins most of what it left open
        centres = _centres(large, sets)
        moved = large.join(centres, "p", "left").select("c", "n", "component", F.coalesce("q", "p").alias("p")).distinct()
        moved = staged(_labelled(moved, labels, own="p"), "moved")
        more = staged(moved.filter("component <> own").select(F.least("p", "c").alias("a"), F.greatest("p", "c").alias("b")).distinct(), "pairs")
        links, labels = _joined(verify, more, links, labels)
        large = staged(_open_families(moved.select("p", "c", "n"), labels), "live")
        pairs, links, labels = _through_pivot(large, sets, percent, verify, links, labels)
        last = last.unionByName(pairs).distinct()
    last = staged(_labelled(last, labels, x="a", y="b").filter("x <> y").select("a", "b"), "pairs")
    return links.unionByName(staged(verify(last), "links"))
