"""Line dedup across documents, exact and fuzzy, in DataFrame functions only.

Equal lines are one class (equal 64-bit hashes; of 10^11 different lines some hundred pairs would fall together). The
shingles of a line are its SHINGLE characters from each place on; lines are linked if the Jaccard similarity of their
shingle sets (distinct 32-bit hashes) is PERCENT or more. The MinHash signature, MINIMA minima of 64-bit hashes, is taken over
the same shingles: a line as UTF-32 has the shingle at place i from byte 4 i on, so each place is a row of an explode, cut out
and hashed in constant time, and an aggregate by line keeps the minima without these rows ever leaving their task. Each band
is three of the minima, {i, i + 1, i + 3}. The members of a band's bucket are compared by the exact Jaccard similarity of
their whole sets, and a distributed union-find joins them. Of each component the first line stays, by (doc_id, position); a
null doc_id comes last. Sets are made of lines that share a band only.

Misses: a pair of similarity 0.8 shares no band with a chance of 0.6 %, one of 0.9 of 0.02 %.

Nulls and edges: a null text has no lines and stays null. A line is what stands between "\n"; a line of any length counts
if it has a word, one shorter than SHINGLE is a shingle itself; lines without a word are structure and stay. Very long
lines are taken whole. Rows equal in doc_id and text are one document delivered twice and get equal results. A document all
of whose lines with words go is emptied; drop_repeated_lines leaves such documents out. Empty tables give empty results.
All columns of docs stay, whatever their names; those added here begin with "__ss_".
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, maybe_broadcast, staged, unstage
from .components import connected_components
from .pairs import BROADCAST_ROWS, bucket_links, confirmed, shared_buckets

PERCENT, SHINGLE, MINIMA = 80, 10, 12
BANDS = [(i, (i + 1) % MINIMA, (i + 3) % MINIMA) for i in range(MINIMA)]

#: Places that a row of the explode stands for.
STEP = 4

_random = random.Random(6)
#: Bits turned over before a minimum is taken; the first four differ, so that the minima come from different parts of the hashes.
_TURNED = [(first << 60 | _random.getrandbits(60)) - 2**63 for first in _random.sample(range(16), MINIMA)]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, c, line: the lines that count; c stands for a line's text."""
    # explode_outer: of the inner form Spark derives filters, which would split each text again
    rows = docs.select("doc_id", "th", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike(WORD))
    return rows.select("doc_id", "th", "pos", F.xxhash64("line").alias("c"), "line")


def _points(line: str) -> Column:
    """A line with four bytes for each character."""
    return F.encode(line, "UTF-32")


def _last(points: Column) -> Column:
    """Where the last shingle begins; a shorter line is one shingle."""
    return F.greatest(F.floor(F.octet_length(points) / 4).cast("int") - SHINGLE, F.lit(0))


def _shingle(points: Column, place: Column) -> Column:
    return F.xxhash64(F.substring(points, place * 4 + 1, F.lit(4 * SHINGLE)))


def _signatures(lines: DataFrame) -> DataFrame:
    """(c, m0, m1, ...), once a line: of the shingles' hashes, each time with other bits turned over, the least one.
    A row of the explode stands for STEP places, those behind the last one for that one again."""
    points = lines.select("c", _points("line").alias("points")).select("c", "points", _last(F.col("points")).alias("last"))
    at = points.select("c", "points", "last", F.explode_outer(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("i"))
    h = at.select("c", *[_shingle(F.col("points"), F.least(F.col("i") + j, F.col("last"))).alias(f"h{j}") for j in range(STEP)])
    least = [F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(x)) for j in range(STEP)]) for x in _TURNED]
    return h.groupBy("c").agg(*[F.min(x).alias(f"m{i}") for i, x in enumerate(least)])


def _sets(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, shingles): the distinct shingles of the lines that are asked for."""
    found = lines.select("c", "line").join(maybe_broadcast(wanted, wanted.count(), BROADCAST_ROWS), "c").dropDuplicates(["c"])
    # as the element of an array a line is held once for all its places; a column would be copied for each
    each = F.transform(F.array(_points("line")), lambda p: F.transform(F.sequence(F.lit(0), _last(p)), lambda i: F.shiftright(_shingle(p, i), 32).cast("int")))
    return found.select("c", F.array_distinct(F.get(each, F.lit(0))).alias("shingles"))


def line_links(lines: DataFrame) -> DataFrame:
    """lines by _lines -> (a, b): linked lines by their c."""
    keys = [F.xxhash64(*[f"m{i}" for i in band], F.lit(k)).alias(f"k{k}") for k, band in enumerate(BANDS)]
    signed = staged(_signatures(lines).select("c", *keys), "signatures")
    members = shared_buckets(signed.select("c", F.explode(F.array(*[f"k{k}" for k in range(len(BANDS))])).alias("key")))
    wanted = staged(members.select("c").distinct(), "wanted")
    sets = staged(_sets(lines, wanted), "sets")
    sized = staged(members.join(sets.select("c", F.size("shingles").alias("n")), "c"), "members")
    found = bucket_links(sized, sets, lambda pairs: confirmed(pairs, sets, PERCENT), PERCENT)
    unstage(signed, sets, members, sized)
    return found


def repeated_lines(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, th, text) -> doc_id, th, gone: positions of the lines that another line stands for."""
    lines = _lines(docs)
    labels = connected_components(line_links(lines)).withColumnRenamed("node", "c")
    labels = staged(labels, "labels")
    g = lines.select("doc_id", "th", "pos", "c").join(maybe_broadcast(labels, labels.count(), BROADCAST_ROWS), "c", "left")
    g = staged(g.select("doc_id", "th", "pos", F.coalesce("component", "c").alias("g")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "pos")
    often = staged(g.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g"), "often")
    alike = staged(g.join(maybe_broadcast(often, often.count(), BROADCAST_ROWS), "g"), "alike")  # few of the lines
    first = staged(alike.groupBy("g").agg(F.min(order).alias("first")), "first")
    gone = alike.join(maybe_broadcast(first, first.count(), BROADCAST_ROWS), "g").filter(~order.eqNullSafe(F.col("first"))).select("doc_id", "th", "pos")
    out = staged(gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone")), "gone")
    unstage(g, often, alike, first)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs with text without its repeated lines, and __ss_lines, __ss_gone: lines before, lines gone."""
    base = docs.withColumns({"__ss_th": F.xxhash64("text"), "__ss_parts": F.split("text", "\n")})
    gone = repeated_lines(base.select("doc_id", F.col("__ss_th").alias("th"), "text"))
    rows, places = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    gone = maybe_broadcast(gone.select(F.col("doc_id").alias("__ss_id"), F.col("th").alias("__ss_h"), F.col("gone").alias("__ss_pos")), rows + places // 8, BROADCAST_ROWS)
    x = base.join(gone, (base["__ss_th"] == gone["__ss_h"]) & base["doc_id"].eqNullSafe(gone["__ss_id"]), "left")
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size("__ss_parts")), F.lit(0)).cast("long")
    left = F.array_except(F.sequence(F.lit(0), F.size("__ss_parts") - 1), F.col("__ss_pos"))
    shortened = F.array_join(F.transform(left, lambda i: F.get("__ss_parts", i)), "\n")
    text = F.when(F.col("__ss_pos").isNull(), F.col("text")).otherwise(shortened)
    x = x.withColumns({"__ss_lines": n_lines, "__ss_gone": F.when(F.col("__ss_pos").isNull(), 0).otherwise(F.size("__ss_pos")).cast("long"), "__ss_text": text})
    return x.select(*[F.col("__ss_text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], "__ss_lines", "__ss_gone")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_gone, text: one row a document."""
    x = dedup_lines(docs.select("doc_id", "text"))
    return x.select("doc_id", F.col("__ss_lines").alias("n_lines"), F.col("__ss_gone").alias("n_gone"), "text")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with shortened texts (n_chars follows, if there is such a column), without the documents emptied by it."""
    x = dedup_lines(docs)
    x = x.filter((F.col("__ss_gone") <= 0) | F.col("text").rlike(WORD)).drop("__ss_lines", "__ss_gone")
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return x
