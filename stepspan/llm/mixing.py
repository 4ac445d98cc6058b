"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source every document is expected target / source_size times. The expected copies are summed up along a fixed
order, one random offset is added, and a document is emitted once for each integer boundary that its share crosses. The
order goes by size class, so the words drawn of a source stay near its target.

The prefix sum is in two levels: documents are counted per (source, size class, slice); the counts, a few thousand rows
a source, are summed up; the rank inside such a piece is a window over that piece. No window spans a whole source.

Nulls: a null text has size 0; null is a source of its own, last in order; a null doc_id sorts first. A source of size
0 has target 0. Rows repeated in full count once each. An empty table gives an empty mix. doc_id may be of any type that
has an order. Texts of any length are counted whole. Only doc_id, text and source are read, so further columns cannot
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, word_count

#: Slices of a (source, size class), so that one common size in a hot source is many pieces.
SLICES = 64


def _size_class(size: Column) -> Column:
    """Bits of the size and the two bits after the highest: classes a fifth of an octave wide."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 2, 2))


def _slice(docs: DataFrame) -> Column:
    number = F.col("doc_id") if docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte") else F.xxhash64("doc_id")
    return (F.pmod(F.coalesce(number, F.lit(0)), F.lit(1000003)) * 7919 % SLICES).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """(source, source_size) -> with weight and target; one row a source. Sources share the sum of all sizes by weight;
    none gets more than repeats times its size, and what is cut off is shared again among the others.

    The level of the others is found in closed form: with sources by cap / weight, a source is cut off if its cap lies
    below the level that holds when all before it are cut off.
    """
    ordered = W.orderBy(F.asc_nulls_last("source"))
    by_ratio = W.orderBy("ratio", F.asc_nulls_last("source"))
    before, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = (
        per_source.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    x = x.withColumn("level", left / free)
    x = x.withColumn("top", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every))
    target = F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("top") * F.col("weight"))
    return x.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, n_copies, taken: one row a document, n_copies 0 if it is not drawn."""
    slim = staged(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).select(
            "*",
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
            _size_class(F.col("size")).alias("cls"),
            _slice(docs).alias("slice"),
        ),
        "mix",
    )
    pieces = staged(slim.groupBy("key", "source", "cls", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("s")), "mix-pieces")
    per_source = targets(pieces.groupBy("source").agg(F.sum("s").alias("source_size")), weights, repeats)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296
    per_source = per_source.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        offset.alias("offset"),
    )
    along = W.partitionBy("key").orderBy("cls", "slice").rowsBetween(W.unboundedPreceding, -1)
    based = pieces.select("key", "cls", "slice", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base")).join(per_source, "key")
    inside = W.partitionBy("key", "cls", "slice").orderBy("size", "doc_id")
    ranked = slim.withColumn("rank", F.row_number().over(inside)).join(based, ["key", "cls", "slice"])
    upto = F.col("base") + F.col("rank")
    copies = F.floor(F.col("offset") + F.col("rate") * upto) - F.floor(F.col("offset") + F.col("rate") * (upto - 1))
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("n_copies"), (copies * F.col("size")).alias("taken"))


def draw(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, with the number of the copy in __ss_copy. A
    document is known by its id, source and size; where several rows agree in these, their copies are dealt out evenly."""
    key = [F.col("doc_id").alias("__ss_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__ss_source"), F.col("size").alias("__ss_size")]
    taken = mix.select(*key, "n_copies").groupBy("__ss_id", "__ss_source", "__ss_size").agg(F.sum("n_copies").alias("__ss_n"), F.count("*").alias("__ss_rows")).filter("__ss_n > 0")
    rows = docs.withColumns({"__ss_s": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "__ss_w": word_count(F.col("text"))})
    x = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("__ss_id")) & (F.col("__ss_s") == F.col("__ss_source")) & (F.col("__ss_w") == F.col("__ss_size")))
    single, several = x.filter("__ss_rows = 1").withColumn("__ss_own", F.col("__ss_n")), x.filter("__ss_rows > 1")
    place = F.row_number().over(W.partitionBy("__ss_id", "__ss_source", "__ss_size").orderBy(F.xxhash64("text")))
    several = several.withColumn("__ss_own", F.floor(F.col("__ss_n") / F.col("__ss_rows")) + (place <= F.col("__ss_n") % F.col("__ss_rows")).cast("long"))
    both = single.unionByName(several).filter("__ss_own > 0")
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__ss_own").cast("int"))).alias("__ss_copy"))


SQL = """
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), pieces AS (
  SELECT *, lpad(len(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 2, 2) AS cls,
         (((coalesce(doc_id, 0) % 1000003) + 1000003) % 1000003) * 7919 % 64 AS slice FROM slim
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source
), weighed AS (
  SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM per_source
), ratios AS (SELECT *, cap / weight AS ratio FROM weighed
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER w, 0)::BIGINT) / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER w, 0)::BIGINT) AS level
  FROM ratios WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE max(CASE WHEN ratio > level THEN level END) OVER () * weight END AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS rate,
         ('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296 AS off FROM targets
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, slice, size, doc_id NULLS FIRST) AS k FROM pieces
)
SELECT doc_id, size, r.source_size, r.target,
       ((floor(off + rate * k) - floor(off + rate * (k - 1)))::BIGINT * size)::BIGINT AS taken
FROM ranked p JOIN rates r ON p.source IS NOT DISTINCT FROM r.source
"""
